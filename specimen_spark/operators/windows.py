"""Completeness of sequences over sliding windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AMBIGUOUS = "[RYKMSWBDHVN]"


def filter_window(df: DataFrame, start: int, stop: int, max_ambiguous: float = 0.01) -> DataFrame:
    """Rows without outer gaps in [start, stop), long enough, and with few ambiguous positions."""
    part = F.substring("seq", start + 1, stop - start)
    return df.where((F.length(part) == stop - start) & (F.instr(part, "_") == 0) & (F.regexp_count(part, F.lit(AMBIGUOUS)) <= int(max_ambiguous * (stop - start))))


def complete_runs(df: DataFrame, width: int, max_ambiguous: float = 0.01) -> DataFrame:
    """Adds runs: the starts (from, to, from 0) of complete windows, by sums of gaps and codes along the sequence."""
    codes = np.frombuffer(AMBIGUOUS.strip("[]").encode(), np.uint8)
    most = int(max_ambiguous * width)

    def one(seq: str | None) -> list[dict]:
        raw = np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)
        if len(raw) < width:
            return []
        upto = lambda marked: np.concatenate([[0], np.cumsum(marked)])
        gaps, ambiguous = upto(raw == ord("_")), upto(np.isin(raw, codes))
        complete = (gaps[width:] == gaps[:-width]) & (ambiguous[width:] - ambiguous[:-width] <= most)
        edges = np.diff(np.concatenate([[0], complete.astype(np.int8), [0]]))
        return [{"from": int(a), "to": int(b) - 1} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]

    @F.pandas_udf("array<struct<from:int,to:int>>")
    def runs(seqs: pd.Series) -> pd.Series:
        return seqs.map(one)

    return df.withColumn("runs", runs("seq"))


def window_stats(df: DataFrame, width: int = 300, max_ambiguous: float = 0.01) -> DataFrame:
    """For each start: sequences, species and species with several sequences whose window is complete.

    Each run of complete starts is two events, at its first start and behind its last.  Events are
    summed by species and start before the shuffle; running sums along a species, and along all of
    them, have a row for each start at which something changes, so their length is that of a
    sequence at most, whatever number of sequences there is.
    """
    found = complete_runs(df.select("species", "seq"), width, max_ambiguous).select("species", F.explode("runs").alias("r"))
    events = found.select("species", F.explode(F.array(F.struct(F.col("r.from").alias("at"), F.lit(1).alias("d")), F.struct((F.col("r.to") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    changes = events.groupBy("species", "e.at").agg(F.sum("e.d").alias("d")).where("d <> 0")
    n = F.sum("d").over(W.partitionBy("species").orderBy("at"))
    per = changes.withColumn("n", n).withColumn("b", F.col("n") - F.col("d")).withColumn("named", F.col("species").isNotNull().cast("long"))
    over = lambda k: ((F.col("n") > k).cast("long") - (F.col("b") > k).cast("long")) * F.col("named")
    names = ("sequences", "defined", "species", "multi_species")
    sums = [F.sum(c).alias(name) for name, c in zip(names, (F.col("d"), F.col("d") * F.col("named"), over(0), over(1)), strict=True)]
    total = per.groupBy("at").agg(*sums)
    along = W.orderBy("at")
    steps = total.select("at", F.lead("at").over(along).alias("next"), *[F.sum(name).over(along).alias(name) for name in names])
    return steps.where("sequences > 0").select(F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("start"), *names)
