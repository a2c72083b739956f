"""A kept reference and draws against their plain forms."""

import contextlib
import hashlib
import io

import pytest

from specimen_spark.operators import lists, pairs
from specimen_spark.operators.reference import KeptReference
from specimen_spark.plans import fixtures as X
from specimen_spark.streaming.identify import identify_stream

SF = "/root/testdata/sf0.001"


def test_kept_reference(spark, tmp_path):
    s = X.sequences(spark, SF)
    kept = KeptReference.make(s, str(tmp_path / "ref"))
    queries = s.where("ord % 40 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(pairs.query_distances(queries, s, min_overlap=40))
    again = KeptReference(spark, str(tmp_path / "ref"))
    assert rows(kept.distances(queries, min_overlap=40).select(*pairs.query_distances(queries, s).columns)) == want == rows(again.distances(queries, min_overlap=40)) and want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            again.distances(queries).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.getvalue().splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    kept_at = next(i for i in scans if "reference_" in lines[i])
    # what stands between the kept tiles and the scan before them, down from their join
    own = lines[max([i for i in scans if i < kept_at], default=0) + 1 : kept_at]
    assert any("SortMergeJoin" in line for line in lines) and not any("Exchange" in line for line in own)
    with pytest.raises(ValueError, match="longer"):
        kept.distances(spark.createDataFrame([(1, "A" * 700, "a", "b")], "ord long, seq string, species string, genus string"))

    queries.select("ord", "title", "seq", "species", "genus").write.parquet(str(tmp_path / "in"))
    got = {}
    stream = spark.readStream.schema("ord long, title string, seq string, species string, genus string").parquet(str(tmp_path / "in"))
    query = identify_stream(stream, again, lambda df, n: got.update({r["q"]: r["verdict"] for r in df.collect()}), 0.03, 40)
    query.processAllAvailable()
    query.stop()
    assert len(got) == queries.count() and set(got.values()) > {"correct"}


@pytest.mark.parametrize(("n", "k"), [(50, 7), (3000, 1000), (3000, 1), (20, 30), (0, 3)])
def test_draws_are_the_least_hashes(spark, n, k, monkeypatch):
    monkeypatch.setattr(lists, "RANKED", 50)
    got = {}
    for r in lists._draws(spark.range(n).withColumnRenamed("id", "ord"), "ord", k, 3, 5).collect():
        got.setdefault(r["replicate"], set()).add(r["ord"])
    hashed = lambda rep, i: hashlib.md5(f"5|{rep}|{i}".encode()).hexdigest()
    assert got == ({rep: set(sorted(range(n), key=lambda i: hashed(rep, i))[:k]) for rep in (1, 2, 3)} if n else {})
