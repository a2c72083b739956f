"""Pairs of a tile are handed on a slice at a time."""

import numpy as np
import pytest
from test_tiles import OVERLAP, sequences, tidy

from specimen_spark.operators import clusters, grid, near, pairs, ranking, tiles


@pytest.mark.parametrize("slice_", [10, 1 << 17])
def test_slices(monkeypatch, slice_):
    monkeypatch.setattr(pairs, "SLICE", slice_)
    planes = pairs._Planes(["ACGT" * 160] * 40, 10)
    got = list(pairs._met(planes, planes, 40, [k + 1 for k in range(40)], "uncorrected", 1))
    assert max(len(x) for x, *_ in got) <= slice_ + 40
    x, y, overlap, dist = (np.concatenate(c) for c in zip(*got, strict=True))
    assert len(set(zip(x.tolist(), y.tolist(), strict=True))) == 780 and set(overlap) == {640} and not dist.any()


def test_matrix_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_ROWS", 7)
    s = sequences(spark, 64)
    found = clusters.clusters_of(s, 0.05, OVERLAP)
    got = tidy(clusters.cluster_matrix_of(s, found, OVERLAP))
    assert got == tidy(clusters.cluster_matrix(found, pairs.pair_distances(s, min_overlap=OVERLAP))) and got


@pytest.mark.parametrize("length", [64, 300])
def test_ranks_without_a_shuffle_of_pairs(spark, monkeypatch, length):
    monkeypatch.setattr(tiles, "STRIP", 50)
    s = sequences(spark, length)
    got = ranking.rank_neighbours_of(s, OVERLAP)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    want = ranking.rank_neighbours(pairs.mirrored(pairs.pair_distances(s, min_overlap=OVERLAP))).select("q", "m", "rank", "dist")
    assert tidy(got) == tidy(want) and got.count() > 1000


def test_a_lower_block_meets_an_upper_one(spark):
    """Rows of a tile come together no more often than there are pairs, but for those within a block."""
    rows = spark.range(200).select(pairs.F.col("id").alias("ord"))
    x, y, met = pairs.sides(pairs.tiled(rows, [], "ord", 200, 5), "ord", "k2p")
    meet = x.join(y, (pairs.F.col("x.lo") == pairs.F.col("y.lo")) & (pairs.F.col("x.hi") == pairs.F.col("y.hi")))
    assert meet.where(met).count() == 200 * 199 // 2 and meet.count() < 200 * 200 * 0.65
    assert meet.where(met).selectExpr("least(x.ord, y.ord)", "greatest(x.ord, y.ord)").distinct().count() == 200 * 199 // 2


def test_a_method_of_ones_own_may_have_a_direction(spark, monkeypatch):
    monkeypatch.setitem(pairs.METHODS, "first", lambda words: (pairs.F.lit(64), pairs.F.col("x.ord") / 1000.0))
    s = sequences(spark, 64, ragged=False)
    got = pairs.pair_distances(s, "first", 1, blocks=3)
    assert got.where("dist <> a / 1000.0").count() == 0 and got.count() > 100


def test_close_cells_are_found_in_tiles(spark):
    cells = sequences(spark, 64).selectExpr("concat('l', ord % 2) as locus", "if(ord = 7, null, concat('x', ord)) as taxon", "seq", "ord % 5 = 3 as cancelled")
    cells = cells.unionByName(cells.where("taxon = 'x14'"))  # a cell twice doesn't meet itself
    got = grid.find_distances(cells, 0.02, 0.1, None, 10)
    assert "FlatMapGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()
    assert tidy(got) == tidy(grid.cell_distances(cells, "uncorrected", 10, 0.02, 0.1)) and got.count() > 20


@pytest.mark.parametrize("length", [64, 300])
def test_distance_band(spark, length):
    s = sequences(spark, length)
    got = near.distance_band(s, 0.02, 0.2, OVERLAP)
    assert tidy(got) == tidy(pairs.filter_distance(pairs.pair_distances(s, min_overlap=OVERLAP), 0.02, 0.2).select(*got.columns)) and got.count() > 100
    top = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in top and "Join" not in top[: top.index("FlatMapGroupsInPandas")]


def test_ranks_of_several_lists_in_turn(spark, monkeypatch):
    """Each list whole, and the same ranks of several lists one after the other."""
    monkeypatch.setattr(tiles, "LISTS", 3)
    monkeypatch.setattr(tiles, "RANKS", 20)
    s = sequences(spark, 64, ragged=False).repartition(1)
    rows = ranking.rank_neighbours_of(s, OVERLAP).select("q", "rank").withColumn("p", pairs.F.spark_partition_id()).collect()
    runs = [[rows[0]]]
    for x, y in zip(rows, rows[1:]):
        runs[-1].append(y) if (x["p"], x["q"]) == (y["p"], y["q"]) and y["rank"] == x["rank"] + 1 else runs.append([y])
    # but for a block's last list, where it is alone
    assert sum(len(r) > 20 for r in runs) < len({r["q"] for r in rows}) / 3
    lists = {}
    for r in rows:
        lists.setdefault(r["q"], []).append(r["rank"])
    assert all(x == list(range(1, len(x) + 1)) for x in lists.values()) and len(rows) > 5000


def test_close_cells_come_in_runs(spark, monkeypatch):
    """Both directions of a pair are made in the tile, sorted by the cell, and not one after the other."""
    rows = [("l", f"x{k:03}", "ACGTACGTACGTACG" + "ACGT"[k % 4]) for k in range(200)]
    g = spark.createDataFrame(rows, "locus string, taxon string, seq string").withColumn("cancelled", pairs.F.lit(False))
    got = grid.find_distances(g, 0.0, 0.1, None, 10)
    assert "Generate" not in (top := got._jdf.queryExecution().executedPlan().toString())[: top.index("FlatMapGroupsInPandas")]
    found = [(r["taxon"], r["other"], r["overlap"]) for r in got.collect()]
    assert len(found) == len(set(found)) == 200 * 199 and {(y, x, n) for x, y, n in found} == set(found) and {n for *_, n in found} == {16}
    assert sum(x[0] != y[0] for x, y in zip(found, found[1:])) < len(found) / 8
