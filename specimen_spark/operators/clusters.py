"""Single-linkage clusters and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .storage import store


def clusters(sequences: DataFrame, pairs: DataFrame, threshold: float = 0.03, rounds: int = 40) -> DataFrame:
    """(ord, cluster): connected components of pairs within the threshold; a cluster is its smallest ord."""
    near = pairs.where(F.col("bucket") <= int(round(threshold * 100_000)))
    both = store(near.select(F.col("a").alias("ord"), F.col("b").alias("to")).unionByName(near.select(F.col("b").alias("ord"), F.col("a").alias("to"))))
    state = store(sequences.select("ord", F.col("ord").alias("cluster")))
    for _ in range(rounds):
        low = both.join(state.select(F.col("ord").alias("to"), F.col("cluster").alias("c")), "to").groupBy("ord").agg(F.min("c").alias("c"))
        step = state.join(low, "ord", "left").select("ord", F.least("cluster", F.coalesce("c", "cluster")).alias("cluster"), F.col("cluster").alias("old"))
        step = store(step)
        jump = step.select(F.col("ord").alias("cluster"), F.col("cluster").alias("c"))
        state = store(step.join(jump, "cluster", "left").select("ord", F.coalesce("c", "cluster").alias("cluster"), "old"))
        if state.where("cluster <> old").isEmpty():
            return state.select("ord", "cluster")
        state = state.select("ord", "cluster")
    raise RuntimeError("clusters did not settle")


def clusters_of(sequences: DataFrame, threshold: float = 0.03, min_overlap: int = 300) -> DataFrame:
    """clusters by all pairs of the sequences; of each tile only links that connect as much as all its pairs leave it."""
    return clusters(sequences, tiles.links(sequences, threshold, min_overlap), threshold)


def _kinds(sequences: DataFrame) -> DataFrame:
    return sequences.select("ord", F.coalesce("species", F.concat(F.lit("{"), F.col("title"), F.lit("}"))).alias("kind"))


def cluster_report(sequences: DataFrame, found: DataFrame, pairs: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Per cluster: size, species, largest distance, pairs over the threshold, and its status.

    perfect: one species, all of it; split: one species, not all; lumped: all of several species;
    lumped+split: several, some not whole.  An unnamed sequence is a species of its own.
    """
    inside = pairs.join(found.select(F.col("ord").alias("a"), F.col("cluster").alias("ca")), "a").join(found.select(F.col("ord").alias("b"), F.col("cluster").alias("cb")), "b").where("ca = cb")
    stats = inside.groupBy(F.col("ca").alias("cluster")).agg(F.max("dist").alias("max_dist"), F.count(F.lit(1)).alias("valid_pairs"), F.sum(F.when(F.col("bucket") > int(round(threshold * 100_000)), 1).otherwise(0)).alias("over"))
    return _reported(sequences, found, stats)


def cluster_report_of(sequences: DataFrame, found: DataFrame, threshold: float = 0.03, min_overlap: int = 300) -> DataFrame:
    """cluster_report by all pairs within each cluster, none of which leaves its tile."""
    return _reported(sequences, found, tiles.group_stats(sequences.join(found, "ord"), "cluster", threshold, min_overlap))


def _reported(sequences: DataFrame, found: DataFrame, stats: DataFrame) -> DataFrame:
    kinds = _kinds(sequences).join(found, "ord")
    per = kinds.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("here"))
    totals = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    shape = per.join(totals, "kind").groupBy("cluster").agg(F.sum("here").alias("size"), F.count(F.lit(1)).alias("species"), F.max((F.col("here") < F.col("total")).cast("int")).alias("partial"))
    status = F.when(F.col("species") == 1, F.when(F.col("partial") == 0, "perfect").otherwise("split")).otherwise(F.when(F.col("partial") == 0, "lumped").otherwise("lumped+split"))
    return shape.join(stats, "cluster", "left").select("cluster", "size", "species", "max_dist", F.coalesce("valid_pairs", F.lit(0)).alias("valid_pairs"), F.coalesce("over", F.lit(0)).alias("over"), status.alias("status"))


def species_cluster_report(sequences: DataFrame, found: DataFrame) -> DataFrame:
    """Per species: its clusters, the other species in them, and the extent its clusters share."""
    kinds = _kinds(sequences).join(found, "ord").join(sequences.select("ord", "first_real", "last_real"), "ord")
    per = kinds.groupBy("kind", "cluster").agg(F.min("first_real").alias("lo"), F.max("last_real").alias("hi"))
    # a kind in one cluster meets all other kinds of it; only those in several clusters need their kinds told apart
    sizes = per.groupBy("cluster").agg(F.count(F.lit(1)).alias("kinds"))
    own = per.join(sizes, "cluster").groupBy("kind").agg(F.count(F.lit(1)).alias("clusters"), F.max("kinds").alias("_most"), F.greatest(F.lit(0), F.min("hi") - F.max("lo") + 1).alias("shared_extent"))
    several = per.join(own.where("clusters > 1").select("kind"), "kind").select(F.col("kind").alias("_k"), "cluster")
    met = several.join(per.select("kind", "cluster"), "cluster").where("kind <> _k").select("_k", "kind").distinct().groupBy(F.col("_k").alias("kind")).agg(F.count(F.lit(1)).alias("_others"))
    others = own.join(met, "kind", "left").select("kind", F.when(F.col("clusters") == 1, F.col("_most") - 1).otherwise(F.col("_others")).alias("others"))
    own = own.drop("_most")
    return own.join(others, "kind", "left").select("kind", "clusters", F.coalesce("others", F.lit(0)).alias("others"), "shared_extent")


def cluster_matrix(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distances between members of each cluster, long form."""
    x = pairs.join(found.select(F.col("ord").alias("a"), "cluster"), "a").join(found.select(F.col("ord").alias("b"), F.col("cluster").alias("_c")), "b")
    return x.where("cluster = _c").select("cluster", "a", "b", "dist")


def cluster_matrix_of(sequences: DataFrame, found: DataFrame, min_overlap: int = 300) -> DataFrame:
    """cluster_matrix by comparing the members of each cluster only."""
    return tiles.group_pairs(sequences.join(found, "ord"), "cluster", min_overlap)
