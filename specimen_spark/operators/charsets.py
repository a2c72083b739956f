"""Intervals of positions: overlaps, splitting, re-basing of codon positions, merging of runs.

charsets: source, name, pos (null or 0-3), from, to (1-based, inclusive), stride (1 or 3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import overlap_join, overlaps


def check_overlaps(charsets: DataFrame) -> DataFrame:
    """Pairs of different sets of one source that share a position; stride-3 sets only on one track."""
    met = overlaps(charsets.select("source", "name", "from", "to", "stride"), ["source"], "name")
    apart = (F.col("x.stride") == 3) & (F.col("y.stride") == 3) & (F.pmod(F.col("x.from") - F.col("y.from"), F.lit(3)) != 0)
    return met.where(~apart).select("x.source", F.col("x.name").alias("a"), F.col("y.name").alias("b"), *[F.col(c).cast(charsets.schema["from"].dataType).alias(c) for c in ("first", "last")])


def split_by_charset(sequences: DataFrame, charsets: DataFrame) -> DataFrame:
    """(name, ord, title, seq): the sorted intervals of each set cut out and joined; empty ones left out."""
    cuts = charsets.where("coalesce(pos, 0) = 0").groupBy("source", "name").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("iv"))
    rows = sequences.join(cuts, "source")
    seq = F.array_join(F.transform("iv", lambda i: F.substring(F.col("seq"), i["from"], i["to"] - i["from"] + 1)), "")
    return rows.select("name", "ord", "title", seq.alias("seq")).where("length(seq) > 0")


def rebase_positions(charsets: DataFrame, cuts: DataFrame) -> DataFrame:
    """Codon positions (stride 3) within cuts (source, name, from, to), numbered from the cut's start.

    A position keeps its track: the first position of the track at or after the cut's start.
    """
    p = charsets.where("coalesce(pos, 0) > 0").select("source", "pos", F.col("from").alias("f"), F.col("to").alias("t"), "stride")
    c = cuts.select("source", "name", F.col("from").alias("cf"), F.col("to").alias("ct"))
    met = overlap_join(p, c, ["source"], ("f", "t"), ("cf", "ct")).select("x.*", "y.name", "y.cf", "y.ct")
    first = F.when(F.col("f") >= F.col("cf"), F.col("f")).otherwise(F.col("cf") + F.pmod(F.col("f") - F.col("cf"), F.col("stride")))
    out = met.withColumn("first", first).withColumn("last", F.least("t", "ct")).where("first <= last")
    return out.select("source", "name", "pos", (F.col("first") - F.col("cf") + 1).alias("from"), (F.col("last") - F.col("cf") + 1).alias("to"), "stride")


def combine_intervals(intervals: DataFrame, step: int = 1) -> DataFrame:
    """Runs of intervals (name, from, to) that follow each other by `step`, merged (gaps and islands)."""
    w = W.partitionBy("name").orderBy("from", "to")
    before = F.max("to").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("from") > before + step), 1).otherwise(0)
    runs = intervals.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("name", "_g").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("_g")
