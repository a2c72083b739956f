"""Filters, orders, set operations, sampling and edits on lists of sequences."""

from __future__ import annotations

import math

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import display_name, normalise, parse_titles, profile


def filter_species(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the named species, count per requested name with 0 where there is none)."""
    asked = df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    key = F.lower("species")
    kept = df.join(F.broadcast(asked.select(F.lower("name").alias("_n")).distinct()), key == F.col("_n"), "left_semi")
    counts = asked.join(kept.groupBy(F.lower("species").alias("_n")).agg(F.count(F.lit(1)).alias("n")), F.lower("name") == F.col("_n"), "left")
    return kept, counts.select("name", F.coalesce("n", F.lit(0)).alias("n"))


def filter_multi(df: DataFrame) -> DataFrame:
    """Rows of species that have several sequences; counts are combined before the join."""
    many = df.where("species is not null").groupBy("species").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("species")
    return df.join(many, "species", "left_semi")


def filter_with_valid_partner(df: DataFrame, valid_pairs: DataFrame) -> DataFrame:
    """Rows that occur in a valid pair; pass pairs within species for true conspecifics."""
    ids = valid_pairs.select(F.col("a").alias("ord")).unionByName(valid_pairs.select(F.col("b").alias("ord"))).distinct()
    return df.join(ids, "ord", "left_semi")


def drop_species(df: DataFrame, name: str | None) -> DataFrame:
    return df.where(~F.col("species").eqNullSafe(F.lit(name)))


def drop_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("ord"), "ord", "left_anti")


def keep_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("ord"), "ord", "left_semi")


def contains_all(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row: whether every id of other is in df, and how many are missing."""
    return drop_rows(other, df).agg(F.count(F.lit(1)).alias("missing")).withColumn("contains_all", F.col("missing") == 0)


def equal_lists(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row: whether both lists have the same rows (ord, title, seq), however often each occurs."""
    count = lambda x, n: x.groupBy("ord", "title", "seq").agg(F.sum(F.lit(n)).alias("n"))
    both = count(df, 1).unionByName(count(other, -1)).groupBy("ord", "title", "seq").agg(F.sum("n").alias("n"))
    return both.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("different")).withColumn("equal", F.col("different") == 0)


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """Both lists, the second after the first."""
    last = F.broadcast(df.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("_s")))
    return df.unionByName(other.crossJoin(last).withColumn("ord", F.col("ord") + F.col("_s")).drop("_s"))


def draw(seed: int, *keys: str) -> Column:
    """A hash that puts keys in a random order, the same on every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def order_of(kind: str, seed: int = 0) -> list[Column]:
    """Sort columns: name, length, gi, family, ambiguous, random or random_in_species."""
    shuffled = draw(seed, "ord")
    share = F.round(F.try_divide(F.col("ambiguous").cast("double"), F.col("length")), 6)
    return {
        "name": [F.col("warning"), F.lower(display_name()), F.col("ord")],
        "length": [F.desc("actual_length"), F.col("ord")],
        "gi": [F.col("gi").cast("long").asc_nulls_first(), F.col("ord")],
        "family": [F.asc_nulls_last("family"), F.col("ord")],
        "ambiguous": [share.desc_nulls_last(), F.col("ord")],
        "random": [shuffled, F.col("ord")],
        "random_in_species": [F.asc_nulls_last("species"), shuffled.desc(), F.col("ord")],
    }[kind]


def sort_list(df: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    return df.orderBy(*order_of(kind, seed))


#: Keys of a replicate that are ranked in one piece, about.
RANKED = 1000


def _draws(keys: DataFrame, key: str, k: int, replicates: int, seed: int) -> DataFrame:
    """The k keys of least hash for each replicate, whatever number of keys there is.

    Keys are counted by the first digits of their hash, before any shuffle; of those that begin like
    the kth only, some RANKED keys, are ranks needed.
    """
    digits = max(1, math.ceil(math.log(max(keys.count(), 1) / RANKED, 16)))
    reps = keys.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), key).withColumn("_h", draw(seed, "replicate", key)).withColumn("_p", F.substring("_h", 1, digits))
    counts = reps.groupBy("replicate", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("replicate").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = reps.join(counts.withColumn("_b", before).where(F.col("_b") < k), ["replicate", "_p"])
    rank = F.row_number().over(W.partitionBy("replicate").orderBy("_h", key))
    edge = met.where(F.col("_b") + F.col("_n") > k).withColumn("_r", rank).where(F.col("_r") <= k - F.col("_b"))
    return met.where(F.col("_b") + F.col("_n") <= k).select("replicate", key).unionByName(edge.select("replicate", key))


def sample_species(df: DataFrame, k: int, replicates: int, seed: int = 0) -> DataFrame:
    """k species without replacement per replicate, with all their sequences."""
    return df.join(_draws(df.where("species is not null").select("species").distinct(), "species", k, replicates, seed), "species")


def sample_specimens(df: DataFrame, k: int, replicates: int, seed: int = 0) -> DataFrame:
    return df.join(_draws(df.select("ord"), "ord", k, replicates, seed), "ord")


def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """New titles and residues by ord (null: unchanged); digits and blanks in residues are dropped."""
    e = edits.select("ord", F.col("title").alias("_t"), F.regexp_replace("seq", r"[\d\s]", "").alias("_s"))
    out = df.select("ord", "title", "seq").join(e, "ord", "left")
    out = out.select("ord", F.coalesce("_t", "title").alias("title"), F.when(F.col("_s").isNotNull(), normalise(F.col("_s"))).otherwise(F.col("seq")).alias("seq"))
    return profile(parse_titles(out))
