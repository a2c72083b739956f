"""Long sequences, compared tile by tile in numpy, against the columns of bit planes."""

import pytest
from test_near import SCHEMA, mutants

from specimen_spark.operators import grid, pairs


def rows_of(df):
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def both_ways(monkeypatch, result):
    found = rows_of(result())
    monkeypatch.setattr(pairs, "COLUMN_WORDS", 10_000)
    assert found == rows_of(result()) and found
    return found


@pytest.mark.parametrize("method", ["uncorrected", "k2p", "transversions"])
@pytest.mark.parametrize("block", [7, 2048])
def test_queries(spark, monkeypatch, method, block):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", block)
    df = spark.createDataFrame([*mutants(5, 60, 700, 6, 40, True), (70, "", "", None, None, None), (71, "n", None, None, None, None), (72, "q", "????", "G s1", "G", "s1")], SCHEMA).repartition(3)
    found = both_ways(monkeypatch, lambda: pairs.query_distances(df.where("ord % 5 = 0"), df, method, 100).select("q", "m", "species_q", "species_m", "genus_q", "genus_m", "overlap", "dist", "bucket", "mismatches"))
    assert {r[0] for r in found} <= set(range(0, 60, 5)) and all(r[0] != r[1] for r in found)


def cells(spark):
    rows = [(i, f"locus{i % 3 if i % 2 else 0}", f"taxon{i % 17}", seq, i % 11 == 0, 0) for i, _, seq, *_ in mutants(9, 70, 650, 4, 30, True)]
    rows += [(80, "locus9", "taxon1", "ACGT", False, 0), (81, "locus0", "taxon90", None, False, 0)]
    kept = list({(r[1], r[2]): r for r in rows}.values())
    return spark.createDataFrame(kept, "ord long, locus string, taxon string, seq string, cancelled boolean, actual_length int").repartition(3)


@pytest.mark.parametrize("method", ["uncorrected", "k2p", "transversions"])
def test_cells(spark, monkeypatch, method):
    df = cells(spark)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 5)
    found = both_ways(monkeypatch, lambda: grid.cell_distances(df, method, 20, 0.0, 0.6).select("locus", "taxon", "other", "overlap", "dist"))
    assert {(r[0], r[2], r[1]) for r in found} == {(r[0], r[1], r[2]) for r in found}


@pytest.mark.parametrize("method", ["uncorrected", "k2p", "transversions"])
def test_reference(spark, monkeypatch, method):
    df = cells(spark)
    found = both_ways(monkeypatch, lambda: grid.reference_distances(df, "taxon1", method, 20))
    assert {"ok", "reference", "no data"} <= {r[2] for r in found}
