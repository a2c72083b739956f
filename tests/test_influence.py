"""Influence with every taxon as the reference, in blocks of references, against all distances joined."""

import pytest
from test_tiles import sequences

from specimen_spark.operators import grid, influence


def cells(spark, width):
    s = sequences(spark, 4 * width, ragged=False)
    return s.selectExpr("ord", "explode(sequence(0, 3)) as k", "seq").where("(ord + k) % 6 <> 0").selectExpr(
        "concat('l', k) as locus", "concat('x', ord % 37, '-', ord) as taxon", "ord", f"substring(seq, k * {width} + 1, {width} - if(k = 1, 3, 0)) as seq", "ord % 17 = 3 as cancelled"
    )


def joined(g, method, least):
    dists = grid.cell_distances(g, method, least).selectExpr("other as reference", "locus", "taxon", "dist", "'ok' as status")
    return grid.correlation_influence(dists, 5, ["reference"], g.selectExpr("count(distinct locus) as k"))


def near(got, want):
    """Sums are added in another order, so that r agrees but for its last digit, and with it the order of cells."""
    got, want = ({(r["reference"], r["locus"], r["place"]): r["average_r"] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(got) > 500
    assert all(abs(got[k] - want[k]) < 3e-7 for k in got)


@pytest.mark.parametrize("width, method, chunk, table", [(16, "transversions", 50, 1 << 16), (16, "uncorrected", 1 << 15, 1 << 16), (70, "transversions", 30, 10), (25, "uncorrected", 1 << 15, 10)])
def test_blocks_of_references(spark, monkeypatch, width, method, chunk, table):
    monkeypatch.setattr(influence, "CHUNK", chunk)
    monkeypatch.setattr(influence, "TABLE", table)
    g = cells(spark, width)
    got = grid.influence_of_all(g, method, 3, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    near(got, joined(g, method, 3))


def test_a_cell_twice_and_no_cells(spark):
    g = cells(spark, 16)
    twice = g.unionByName(g.where("taxon = 'x4-4'"))
    near(grid.influence_of_all(twice, "transversions", 3, 5), joined(twice, "transversions", 3))
    assert grid.influence_of_all(g.where("false")).count() == 0


def test_equal_cells_by_name(spark):
    """Of cells of equal influence the first by name stay, over chunks."""
    import numpy as np

    block = influence._Block(np.array(["r"], object), None, ["l"], [], 1, 2)
    block._offer(0, 0, np.array([0.5, 0.25, 0.5]), 0.0, np.array(["a", "b", "c"], object))
    block._offer(0, 0, np.array([0.5, 0.75]), 0.0, np.array(["d", "e"], object))
    value, names = block.best[0][0]
    assert value.tolist() == [0.75, 0.5] and names.tolist() == ["e", "a"]
