"""Answers worked out inside tiles against the same from stored pairs."""

import numpy as np
import pytest
from test_near import SCHEMA, mutants

from specimen_spark.operators import clusters, pairs, ranking, storage, summaries, tiles

OVERLAP = 30


def sequences(spark, length, species=6, ragged=True):
    """Sequences of several species of two genera, copies, unnamed, short and empty ones among them."""
    rng = np.random.default_rng(length)
    rows = []
    for i, title, seq, *_ in mutants(length, 90, length, 5, 12, ragged):
        k = int(rng.integers(species))
        named = (f"G{k % 2} s{k}", f"G{k % 2}", f"s{k}") if i % 9 else (None, None, None)
        rows.append((i * 7 % 1000, title, seq, *named))
    rows += [(1000 + i, rows[i][1], rows[i][2], *rows[i % 4][3:]) for i in range(12)]
    rows += [(2000, "short", "ACG", "G0 s0", "G0", "s0"), (2001, "none", "?" * length, "G1 s1", "G1", "s1"), (2002, "alone", rows[0][2], "H z", "H", "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({"length": pairs.F.length("seq"), "actual_length": pairs.F.length("seq"), "gi": pairs.F.col("ord").cast("string")})


def tidy(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


ASKED = {
    "best": (lambda s: ranking.best_match_of(s, 0.05, OVERLAP), lambda s, p, b: ranking.best_match(s, b, 0.05)),
    "first": (lambda s: ranking.first_con_and_allo_of(s, OVERLAP), lambda s, p, b: ranking.first_con_and_allo(b)),
    "extreme": (lambda s: ranking.extreme_pairwise_of(s, OVERLAP), lambda s, p, b: ranking.extreme_pairwise(b)),
    "barcodes": (lambda s: ranking.all_species_barcodes_of(s, 0.2, OVERLAP), lambda s, p, b: ranking.all_species_barcodes(s, b, 0.2)),
    "explorer": (lambda s: summaries.pairwise_explorer_of(s, min_overlap=OVERLAP), lambda s, p, b: summaries.pairwise_explorer(b.where("species_q = species_m"))),
    "analysis": (lambda s: summaries.distance_analysis_of(s, OVERLAP)[0], lambda s, p, b: summaries.distance_analysis(s, b)[0]),
    "partners": (lambda s: summaries.species_summary_of(s, OVERLAP), lambda s, p, b: summaries.species_summary(s, p.where("species_a = species_b"), OVERLAP)),
    "intra": (lambda s: tiles.distance_counts(s, "intra", OVERLAP), lambda s, p, b: summaries.distance_counts(p.where("species_a = species_b"))),
    "inter": (lambda s: tiles.distance_counts(s, "inter_congeneric", OVERLAP), lambda s, p, b: summaries.distance_counts(p.where("genus_a = genus_b and species_a <> species_b"))),
    "clusters": (lambda s: clusters.clusters_of(s, 0.05, OVERLAP), lambda s, p, b: clusters.clusters(s, p, 0.05)),
    "report": (lambda s: clusters.cluster_report_of(s, clusters.clusters_of(s, 0.05, OVERLAP), 0.05, OVERLAP), lambda s, p, b: clusters.cluster_report(s, clusters.clusters(s, p, 0.05), p, 0.05)),
}


@pytest.mark.parametrize("block", [7, 8192])
@pytest.mark.parametrize("length", [64, 300])
def test_same_as_from_pairs(spark, monkeypatch, length, block):
    monkeypatch.setattr(tiles, "TILE_ROWS", block)
    monkeypatch.setattr(tiles, "STRIP", 50)
    s = sequences(spark, length)
    p = storage.store(pairs.pair_distances(s, min_overlap=OVERLAP))
    b = pairs.mirrored(p)
    for name, (got, want) in ASKED.items():
        found = tidy(got(s))
        assert found == tidy(want(s, p, b)) and len(found) > 5, name


@pytest.mark.parametrize("length", [64, 300])
def test_transversions(spark, length):
    s = sequences(spark, length)
    p = pairs.pair_distances(s, "transversions", OVERLAP, "intra")
    assert tidy(tiles.distance_counts(s, "intra", OVERLAP, "transversions")) == tidy(summaries.distance_counts(p))


def test_equal_sequences_leave_their_tiles_as_rows(spark):
    """Copies are all pairs of each other: what leaves a tile is no more than its rows."""
    s = spark.createDataFrame([(i, "t", "ACGT" * 16, None if i % 2 else "G a", None if i % 2 else "G", "a") for i in range(600)], SCHEMA).repartition(4)
    links = tiles.links(s, 0.03, OVERLAP)
    assert links.count() < 600 * 8
    assert tiles.nearest_blocks(s, OVERLAP).count() < 600 * 16
    assert {r["cluster"] for r in clusters.clusters(s, links, 0.03).collect()} == {0}
    best = ranking.best_match_of(s, 0.03, OVERLAP).where("species_q is not null").select("ties", "species_in_block", "verdict").distinct().collect()
    assert [tuple(r) for r in best] == [(599, 301, "ambiguous")]
