"""Similarity joins by segments against all pairs."""

import numpy as np
import pytest

from specimen_spark.operators import clusters, near, pairs
from specimen_spark.plans import fixtures as X

SCHEMA = "ord long, title string, seq string, species string, genus string, species_epithet string"


def mutants(seed, n, length, groups, changes, ragged=False, codes=0.02):
    rng = np.random.default_rng(seed)
    parents = rng.choice(list("ACGT"), (groups, length))
    rows = []
    for i in range(n):
        g = int(rng.integers(groups))
        own = parents[g].copy()
        for at in rng.integers(0, length, int(rng.integers(0, changes))):
            own[at] = rng.choice(list("ACGT-"))
        for at in np.flatnonzero(rng.random(length) < codes):
            own[at] = rng.choice(list("RYKMSWBDHVN?"))
        own[: int(rng.integers(0, 8))] = "_"
        text = "".join(own)
        rows.append((i, f"t{g}", text[: int(rng.integers(length // 8, length))] if ragged and i % 5 == 0 else text, f"G s{g}", "G", f"s{g}"))
    return rows


def both_ways(df, threshold, overlap):
    columns = ["a", "b", "species_a", "species_b", "genus_a", "genus_b", "twins", "overlap", "dist", "bucket"]
    got = sorted(map(tuple, near.near_pairs(df, threshold, overlap).select(*columns).collect()))
    every = pairs.pair_distances(df, min_overlap=overlap).where(f"bucket <= {round(threshold * 100_000)}")
    return got, sorted(map(tuple, every.select(*columns).collect()))


@pytest.mark.parametrize(("length", "threshold", "changes", "ragged"), [(64, 0.03, 4, False), (200, 0.0, 3, False), (660, 0.03, 30, False), (300, 0.05, 20, True), (40, 0.5, 20, False)])
def test_no_pair_is_lost(spark, length, threshold, changes, ragged):
    df = spark.createDataFrame(mutants(length, 150, length, 12, changes, ragged), SCHEMA).repartition(4)
    got, want = both_ways(df, threshold, 30)
    assert got == want and len(want) > 5


def test_keys_of_very_many_sequences_and_side_lists(spark, monkeypatch):
    monkeypatch.setattr(near, "MEET", 16)
    monkeypatch.setattr(near, "READINGS", 8)
    df = spark.createDataFrame(mutants(5, 160, 128, 2, 5, True, 0.05), SCHEMA).repartition(4)
    got, want = both_ways(df, 0.04, 20)
    assert got == want and len(want) > 1000


def test_few_pairs_are_candidates(spark):
    """Of sequences in many groups only those of one group are measured."""
    rows = mutants(9, 600, 660, 60, 12, codes=0.005)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("'' as grp", "ord as id", "seq")
    assert near.candidates(df, 0.03, 660).count() < 0.05 * 600 * 600
    assert near.layout(near.most_mismatches(0.03, 660), 660)[0] > 19


def test_bounds_of_mismatches():
    assert near.most_mismatches(0.03, 64) == 1 and near.most_mismatches(0.03, 660) == 19 and near.most_mismatches(0, 64) == 0
    for m in range(0, 20):
        for columns in (20, 64, 300, 660):
            found = near.layout(m, columns)
            if found:
                segments, of_key, out = found
                assert segments <= columns and segments - m - 2 * out >= of_key


def test_clusters_equal_those_of_all_pairs(spark):
    rows = mutants(3, 200, 64, 20, 4)
    rows += [(1000 + i, "t0", rows[0][2], "G s0", "G", "s0") for i in range(40)] + [(2000 + i, "n", "?" * 64, None, None, None) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    every = clusters.clusters(df, pairs.pair_distances(df, min_overlap=X.MIN_OVERLAP), 0.03)
    links = near.near_links(df, 0.03, X.MIN_OVERLAP)
    assert sorted(map(tuple, clusters.clusters(df, links, 0.03).collect())) == sorted(map(tuple, every.collect()))
    empty = df.limit(0)
    assert near.near_pairs(empty, 0.03).count() == 0 and near.near_links(empty, 0.03).count() == 0


def test_index_and_tiles_find_the_same(spark, monkeypatch):
    rows = mutants(64, 150, 64, 12, 4) + [(5000, None, "ACGT" * 16, None, None, None), (5001, None, "ACGT" * 16, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    cells = df.selectExpr("concat('l', ord % 2) as locus", "concat('x', ord) as taxon", "seq", "false as cancelled")
    best = ["q", "species_q", "best_bucket", "best_dist", "ties", "species_in_block", "has_conspecific", "verdict", "close_verdict"]
    asked = {
        "pairs": lambda: near.near_pairs(df, 0.03, 30), "cells": lambda: near.near_cells(cells, 0.03, 30), "best": lambda: near.near_best_match(df, 0.03, 30).select(*best),
        "clusters": lambda: clusters.clusters(df, near.near_links(df, 0.03, 30), 0.03),
    }
    found = {}
    for way, (few, share) in {"tiles": (1 << 27, 0), "dense": (0, 0), "index": (0, 1 << 20)}.items():
        monkeypatch.setattr(near, "FEW", few)
        monkeypatch.setattr(near, "SHARE", share)
        for name, ask in asked.items():
            got = ask()
            found[way, name] = sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=repr)
            assert found[way, name] == found["tiles", name] and len(found[way, name]) > 5, (way, name)


def test_close_pairs_are_not_shuffled(spark):
    """What is near leaves its tile at once: the rows alone are dealt out, and nothing is joined or made distinct afterwards."""
    df = spark.createDataFrame(mutants(7, 150, 64, 2, 4), SCHEMA)
    plan = near.near_pairs(df, 0.03, 30)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Join" not in plan and "HashAggregate" not in plan
