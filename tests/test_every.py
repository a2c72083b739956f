"""Pairs as rows that leave their tile at once, against the same from joined rows."""

import numpy as np
import pytest
from test_tiles import OVERLAP, sequences, tidy

from specimen_spark import plans
from specimen_spark.operators import every, near, pairs, tiles

F = pairs.F


@pytest.mark.parametrize("length", [64, 300])
@pytest.mark.parametrize("method", every.METHODS)
@pytest.mark.parametrize("scope", ["all", "intra", "inter_congeneric"])
def test_every_pair(spark, monkeypatch, length, method, scope):
    monkeypatch.setattr(tiles, "TILE_ROWS", 23)
    monkeypatch.setattr(tiles, "STRIP", 200)
    monkeypatch.setattr(every, "WIDTH", 7)
    s = sequences(spark, length)
    for columns in ("overlap int, dist double", "overlap int, dist double, bucket long"):
        got = every.every_pair(s, columns, method, OVERLAP, scope)
        want = pairs.pair_distances(s, method, OVERLAP, scope)
        assert tidy(got) == tidy(want.select(*got.columns)) and got.count() > 100


@pytest.mark.parametrize("length", [64, 300])
def test_pairs_that_are_not_valid(spark, length):
    s = sequences(spark, length)
    got = every.every_pair(s, "species string, overlap int", min_overlap=0, scope="intra", valid_only=False)
    assert tidy(got) == tidy(pairs.overlap_report(s)) and got.where("overlap = 0").count() > 0
    far = every.every_pair(s, "overlap int, dist double", "k2p", 5, "all", False, 6)
    want = pairs.pair_distances(s, "k2p", 5, valid_only=False).where("overlap >= 5")
    assert tidy(far) == tidy(want.select("a", "b", "overlap", F.round("dist", 6).alias("dist")))


def test_by_k2p_a_pair_has_known_bases(spark):
    """Codes other than those of purines and pyrimidines overlap, but say nothing of transitions."""
    rows = [(k, "t", seq, "G s", "G", "s") for k, seq in enumerate(["N" * 40, "ACGT" * 10, "K" * 40, "CATG" * 10])]
    s = spark.createDataFrame(rows, "ord long, title string, seq string, species string, genus string, species_epithet string")
    got = every.every_pair(s, "overlap int, dist double", "k2p", 10, "all", False, 6).collect()
    assert [(r["a"], r["b"], r["overlap"], r["dist"]) for r in got] == [(1, 3, 40, None)]


@pytest.mark.parametrize("length", [64, 300])
def test_query_pairs(spark, monkeypatch, length):
    monkeypatch.setattr(tiles, "TILE_ROWS", 23)
    monkeypatch.setattr(tiles, "STRIP", 200)
    s = sequences(spark, length)
    got = every.query_pairs(s.where("ord % 3 = 0"), s, min_overlap=OVERLAP)
    assert tidy(got) == tidy(pairs.query_distances(s.where("ord % 3 = 0"), s, min_overlap=OVERLAP).select(*got.columns)) and got.count() > 500
    assert every.query_pairs(s.where("false"), s, min_overlap=OVERLAP).count() == 0


@pytest.mark.parametrize("words", [1, 9])
def test_rows_of_equal_values_come_together(words):
    """Of each row where rows are short, else of a strip; without them, partners come in the same order. So files of pairs are small."""
    rng = np.random.default_rng(words)
    overlap = rng.integers(38, 44, (8, 600)).astype(np.uint16)
    counts, keep = np.stack([overlap, overlap - rng.integers(0, 5, (8, 600)).astype(np.uint16)]), rng.random((8, 600)) < 0.9
    found = lambda runs: every.Found("uncorrected", ["overlap", "dist", "bucket"], 40, True, words, None, runs).of(counts, keep)
    row, partner, out = found(True)
    every_row, every_partner, plain = found(False)
    told = lambda x, y, o: set(zip(x.tolist(), y.tolist(), o["overlap"].tolist(), o["dist"].tolist(), o["bucket"].tolist(), strict=True))
    assert told(row, partner, out) == told(every_row, every_partner, plain) and len(row) == len(every_row) == (keep & (overlap >= 40)).sum()
    changes = lambda x, *more: int(sum((np.diff(c) != 0 for c in more), np.diff(x) != 0).astype(bool).sum())
    most = 4 * 5 * (8 if words == 1 else 1)
    assert changes(out["overlap"], out["bucket"]) < most < len(row) / 10
    assert changes(row) == (7 if words == 1 else changes(row)) and changes(every_row) == 15
    first = [every_partner[(every_row == r) & (every_partner < every.WIDTH)] for r in range(8)]
    assert all((np.diff(x) > 0).all() for x in first)


@pytest.mark.parametrize("name", ["pair_distances", "k2p_distances_all", "transversion_distances_all", "congeneric_pairs", "distance_band", "k2p_distances", "ragged_pair_distances", "ragged_overlap_report", "ragged_query_distances"])
def test_no_pair_is_joined_or_shuffled(spark, name):
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("FlatMapGroupsInPandas")]
    assert "Join" not in top and "Exchange" not in top and "species_a" not in plan
