"""The stored grid: batches, marks, versions, bases and streams."""

import io
import contextlib

import pytest

from specimen_spark.operators.grid import add_to_grid
from specimen_spark.operators.gridstore import GridStore
from specimen_spark.streaming.identify import grow_grid_stream

ROWS = "locus string, taxon string, ord long, seq string"


def cells(df):
    return {(r["locus"], r["taxon"]): (r["seq"], r["cancelled"]) for r in df.collect()}


@pytest.mark.parametrize("compact", [(), (0,), (1, 3), (0, 1, 2, 3, 4)])
def test_versions_don_t_depend_on_bases(spark, tmp_path, compact):
    store = GridStore(spark, str(tmp_path / "g"), 4)
    add = lambda n, *rows: store.append(spark.createDataFrame(rows, ROWS), n)
    want = []
    for n in range(5):
        if n == 0:
            add(0, ("l", "a", 0, "ACG?"), ("l", "b", 1, "ACGT"), ("m", "a", 2, "AA"), ("l", "c", 3, "AC"), ("l", "d", 4, "????"))
            want.append({("l", "a"): ("ACG?", False), ("l", "b"): ("ACGT", False), ("m", "a"): ("AA", False)})
        elif n == 1:
            store.cancel(spark.createDataFrame([("l", "b"), (None, "a"), ("l", "a")], "locus string, taxon string"), 1)
            want.append({("l", "a"): ("ACG?", True), ("l", "b"): ("ACGT", True), ("m", "a"): ("AA", True)})
        elif n == 2:
            add(2, ("l", "a", 0, "TTTT"), ("l", "b", 1, "AC??"), ("m", "z", 2, "A"), ("n", "z", 3, "AAA"))
            want.append(want[-1] | {("l", "a"): ("TTTT", False), ("n", "z"): ("AAA", False)})
        elif n == 3:
            store.cancel(spark.createDataFrame([("l", "b"), ("n", "z"), ("n", "nobody")], "locus string, taxon string"), 3)
            want.append(want[-1] | {("l", "b"): ("ACGT", False), ("n", "z"): ("AAA", True)})
        else:
            add(4, ("l", "b", 0, "GGGG"), ("n", "z", 1, "CC?"), ("n", "y", 2, "TTT"))
            want.append(want[-1] | {("l", "b"): ("GGGG", False), ("n", "y"): ("TTT", False)})
        if n in compact:
            assert store.compact() == n
        assert cells(GridStore(spark, str(tmp_path / "g"), 4).read()) == want[-1]
    for n in range(5):
        assert cells(store.read(n)) == want[n]
    if not compact:
        assert {(r["locus"], r["taxon"], r["batch"]) for r in store.refused().collect()} == {("l", "c", 0), ("m", "z", 2)}


def test_same_as_adding_to_a_grid(spark, tmp_path):
    store = GridStore(spark, str(tmp_path / "g"), 4)
    one = [("l", f"t{i}", i, "ACGT"[: 2 + i % 3] if i % 5 == 4 else "AC?T" if i % 2 else "ACGT") for i in range(40)]
    two = [("l", f"t{i}", i, "A??T" if i % 3 else "TTTT") for i in range(20, 60)]
    for n, rows in enumerate((one, two)):
        store.append(spark.createDataFrame(rows, ROWS), n)
    grid = spark.createDataFrame([], ROWS + ", actual_length int, cancelled boolean")
    for rows in (one, two):
        grid, _ = add_to_grid(grid, spark.createDataFrame(rows, ROWS), "l")
    assert cells(store.read()) == cells(grid)


def test_a_batch_that_comes_again_replaces_itself_and_an_unfinished_one_doesn_t_count(spark, tmp_path):
    store = GridStore(spark, str(tmp_path / "g"), 4)
    assert store.compact() == -1 and cells(store.read()) == {}
    for _ in range(2):
        store.append(spark.createDataFrame([("l", "a", 0, "ACGT")], ROWS), 0)
    (tmp_path / "g/delta/batch=1").mkdir()
    assert cells(store.read()) == {("l", "a"): ("ACGT", False)}


def test_the_base_is_joined_in_its_buckets(spark, tmp_path):
    store = GridStore(spark, str(tmp_path / "g"), 4)
    store.append(spark.createDataFrame([("l", f"t{i}", i, "ACGT") for i in range(100)], ROWS), 0)
    store.compact()
    store.append(spark.createDataFrame([("l", "t1", 0, "TTTT")], ROWS), 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            store.read().explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = text.getvalue().split("\n(1)")[0]
    lines = tree.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "grid_" in line)
    join = next(i for i in range(scan, 0, -1) if "Join" in lines[i] and "FullOuter" in text.getvalue())
    assert not any("Exchange" in line for line in lines[join:scan])


def test_grow_grid_stream(spark, tmp_path):
    schema = "taxon string, ord long, seq string"
    for i in range(3):
        spark.createDataFrame([(f"t{i}", 0, "ACGT"), ("all", 1, "AC?T" if i else "ACGT"), ("short", 2, "AC")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = grow_grid_stream(stream, str(tmp_path / "grid"), "l", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    store = GridStore(spark, str(tmp_path / "grid"))
    assert cells(store.read()) == {("l", x): ("ACGT", False) for x in ("t0", "t1", "t2", "all")}
    assert len(list((tmp_path / "grid/delta").iterdir())) == 3 and store.refused().count() == 3
