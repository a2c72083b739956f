"""Interval joins against all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from specimen_spark.operators import intervals
from specimen_spark.sources import flatfile


def spans(seed, n, keys, reach, longest):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randint(1, reach)
        out.append((rng.choice(keys), i, a, a + (rng.randint(-2, longest) if rng.random() < 0.3 else rng.randint(0, 3))))
    return out


@pytest.mark.parametrize(("seed", "longest"), [(1, 5), (2, 60), (3, 2000)])
def test_all_pairs(spark, seed, longest):
    one, two = spans(seed, 150, ["a", "b", None], 400, longest), spans(seed + 50, 150, ["a", "b", None], 400, longest)
    x, y = (spark.createDataFrame(r, "k string, id long, from long, to long").repartition(3) for r in (one, two))
    meet = lambda p, q: p[0] is not None and p[0] == q[0] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]
    got = sorted(map(tuple, intervals.overlap_join(x, y, ["k"]).select("x.id", "y.id", "first", "last").collect()))
    assert got == sorted((p[1], q[1], max(p[2], q[2]), min(p[3], q[3])) for p in one for q in two if meet(p, q)) and got
    got = sorted(map(tuple, intervals.overlaps(x, ["k"], "id").select("x.id", "y.id", "first", "last").collect()))
    assert got == sorted((p[1], q[1], max(p[2], q[2]), min(p[3], q[3])) for p in one for q in one if p[1] < q[1] and meet(p, q)) and got
    assert intervals.overlaps(x.limit(0), ["k"], "id").count() == 0


def test_many_intervals_of_one_key(spark):
    """100 000 features of one locus, each of which overlaps the next, and one that spans a tenth of them."""
    n = 100_000
    df = spark.range(n).select(F.lit("chr1").alias("k"), "id", (F.col("id") * 10).alias("from"), (F.col("id") * 10 + F.when(F.col("id") == 500, F.lit(n)).otherwise(F.lit(12))).alias("to"))
    began = time.time()
    found = intervals.overlaps(df, ["k"], "id").count()
    # of id 500: all that begin within its reach, and the one before it
    assert found == (n - 1) + (n // 10 - 1) and time.time() - began < 60


def test_a_bin_of_very_many_is_met_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(intervals, "MEET", 16)
    rows = [("f", 0, i, [(5 + i % 7, 11 + i % 3)] if i % 10 else [(1, 6), (5, 30)]) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, locus_id long, feature_id long, location array<struct<from: long, to: long>>")
    meet = lambda p, q: any(a <= d and c <= b for a, b in p[3] for c, d in q[3])
    got = sorted(map(tuple, flatfile.features_intersect(df).collect()))
    assert got == [("f", 0, p[2], q[2]) for p in rows for q in rows if p[2] < q[2] and meet(p, q)] and len(got) > 40_000
    one = df.select("file", "feature_id", F.lit(5).cast("long").alias("_f"), F.lit(9).cast("long").alias("_t"))
    x, y = intervals._dealt(one, one, ["file"])
    assert x.groupBy("_p", "_q").count().agg(F.max("count")).first()[0] < 64 and x.alias("x").join(y.alias("y"), ["file", "_p", "_q"]).count() == 300 * 300
