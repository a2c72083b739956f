"""Intermediate results that outlive executors, and numbering without a single task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: What each session stored, until drop_intermediates.
_made: dict[str, list[str]] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def fresh_path(spark: SparkSession, name: str = "part") -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir).

    Where no such folder is set, a local session, as in tests, makes one; a cluster has none to share.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(_session(spark), []).append(path)
    return path


def store(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path that any of Spark's file systems may hold."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def drop_intermediates(spark: SparkSession) -> int:
    """Deletes what this session's operators stored, and says how many paths; write lazy results that read them first."""
    made = _made.pop(_session(spark), [])
    for path in made:
        fs, at = hadoop_path(spark, path)
        fs.delete(at, True)
    return len(made)


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in the order, which should have no ties.

    Rows are sorted by range; a row's place is its place in its range after those before, so only
    one number for each range is ever gathered.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = store(ranged)
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_p", before.alias("_b")))  # one row for each range
    place = F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(starts, part == F.col("_p")).withColumn(name, place).drop("_id", "_p", "_b")


def cumulated(counts: DataFrame, ascending: bool = True) -> DataFrame:
    """Adds `before`, the number of pairs whose distance comes earlier in the order.

    Distances are sorted by range; only one number for each range is gathered.
    """
    order = F.asc("dist") if ascending else F.desc("dist")
    ranged = store(counts.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sums = ranged.groupBy(part.alias("_p")).agg(F.sum("n").alias("_n"))
    starts = F.broadcast(sums.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b")))  # one row for each range
    within = F.coalesce(F.sum("n").over(W.partitionBy(part).orderBy("_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_w", within).join(starts, part == F.col("_p")).select("dist", "n", (F.col("_b") + F.col("_w")).alias("before"))
