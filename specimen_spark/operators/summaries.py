"""Summaries of sequences and of pair distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tiles
from .pairs import times
from .storage import cumulated, store


def percentage(x, y):
    """Percent with two decimals, cut off, 0 when y is 0."""
    share = F.floor(F.try_divide(x.cast("double"), y.cast("double")) * 100_000) / 100_000
    return F.coalesce(F.floor(share * 10_000) / 100, F.lit(0.0))


def species_summary(df: DataFrame, intra: DataFrame, min_overlap: int) -> DataFrame:
    """Per species: sequences, those with and without a valid partner, the longest, and its GIs."""
    return _species_summary(df, intra.select(F.col("a").alias("ord")).unionByName(intra.select(F.col("b").alias("ord"))).distinct(), min_overlap)


def species_summary_of(df: DataFrame, min_overlap: int) -> DataFrame:
    """species_summary by all pairs within species, none of which leaves its tile."""
    return _species_summary(df, tiles.with_partner(df, min_overlap), min_overlap)


def _species_summary(df: DataFrame, valid: DataFrame, min_overlap: int) -> DataFrame:
    valid = valid.withColumn("valid", F.lit(1))
    rows = df.where("species is not null").join(valid, "ord", "left")
    return rows.groupBy("species").agg(
        F.count(F.lit(1)).alias("total"), F.count("valid").alias("valid"), (F.count(F.lit(1)) - F.count("valid")).alias("invalid"),
        F.max("actual_length").alias("longest"), F.sum(F.when(F.col("length") < min_overlap, 1).otherwise(0)).alias("short"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "gi"))), lambda x: x["gi"]), ",").alias("gis"),
    )


def species_totals(df: DataFrame, per_species: DataFrame, min_overlap: int) -> DataFrame:
    rows = df.agg(
        F.count(F.lit(1)).alias("sequences"), F.count_distinct("species").alias("species"),
        F.sum(F.when(F.col("species").isNull(), 1).otherwise(0)).alias("unnamed"), F.sum(F.when(F.col("length") < min_overlap, 1).otherwise(0)).alias("short"),
    )
    valid = per_species.agg(F.sum("valid").alias("valid_sequences"), F.sum(F.when(F.col("valid") > 0, 1).otherwise(0)).alias("valid_species"))
    return rows.crossJoin(F.broadcast(valid)).withColumn("valid_percent", percentage(F.col("valid_species"), F.col("species")))


def distance_counts(pairs: DataFrame) -> DataFrame:
    """(dist, n): how many pairs have each distance, stored; what is asked of distributions follows from it."""
    return store(pairs.groupBy("dist").agg(F.sum(times(pairs)).alias("n")))


def trimmed_bound(counts: DataFrame, side: str) -> DataFrame:
    """The bound after leaving out 5 %: `intra` from the top, `inter` from the bottom (one row)."""
    # an exact twentieth exceeds the limit, as the share is a 32-bit number
    upto = cumulated(counts, side != "intra")
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))
    least = F.col("before") + (1 if side == "intra" else 0)
    within = upto.crossJoin(total).where((least == 0) | (F.lit(20) * least < F.col("total")))
    if side == "intra":
        return within.agg(F.min("dist").alias("trimmed")).crossJoin(F.broadcast(counts.agg(F.max("dist").alias("top")))).select(F.coalesce("trimmed", "top").alias("trimmed_intra"))
    return within.agg(F.max("dist").alias("trimmed_inter"))


def pairwise_summary(intra: DataFrame, inter: DataFrame) -> DataFrame:
    """One row: ranges within and between species, trimmed bounds, and the pairs in their overlap.

    Pairs are measured once; all else is worked out from the counts of their distances.
    """
    return pairwise_summary_of(distance_counts(intra), distance_counts(inter))


def pairwise_summary_of(within: DataFrame, between: DataFrame) -> DataFrame:
    """pairwise_summary from counts of distances (dist, n)."""
    ends = lambda d, name: d.agg(F.min("dist").alias(f"min_{name}"), F.max("dist").alias(f"max_{name}"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}"))
    one = ends(within, "intra").crossJoin(F.broadcast(ends(between, "inter"))).crossJoin(F.broadcast(trimmed_bound(within, "intra"))).crossJoin(F.broadcast(trimmed_bound(between, "inter")))
    total = lambda lo, hi: F.coalesce(F.sum(F.when(F.col("dist").between(F.col(lo), F.col(hi)), F.col("n"))), F.lit(0))
    inside = within.unionByName(between).crossJoin(F.broadcast(one)).agg(total("min_inter", "max_intra").alias("inside"), total("trimmed_inter", "trimmed_intra").alias("inside_trimmed"))
    return one.crossJoin(F.broadcast(inside)).withColumn("inside_percent", percentage(F.col("inside"), F.col("n_intra") + F.col("n_inter")))


#: Ranges and steps of the standard tables of distances within and between species.
TABLES = ((0.0, 0.2, 0.005), (0.0, 0.3, 0.01), (0.0, 1.0, 0.05))


def standard_tables(intra: DataFrame, inter: DataFrame, direction: str = "forward") -> DataFrame:
    """The six standard histograms: kind (intra or inter), to, step, bin, n, cumulative."""
    return standard_tables_of(distance_counts(intra), distance_counts(inter), direction)


def standard_tables_of(within: DataFrame, between: DataFrame, direction: str = "forward") -> DataFrame:
    """standard_tables from counts of distances (dist, n)."""
    out = None
    for kind, counts in (("intra", within), ("inter", between)):
        for lo, hi, step in TABLES:
            made = distance_histogram(counts, lo, hi, step, direction).select(F.lit(kind).alias("kind"), F.lit(hi).alias("to"), F.lit(step).alias("step"), "bin", "n", "cumulative")
            out = made if out is None else out.unionByName(made)
    return out


def distance_histogram(dist: DataFrame, lo: float, hi: float, step: float, direction: str = "forward") -> DataFrame:
    """Counts by class and cumulated: up to lo, steps above it with both ends, above hi.

    Each distance (with a count n, if there is such a column) is put in its classes by arithmetic;
    only counts per class are shuffled.
    """
    weight = F.col("n") if "n" in dist.columns else F.lit(1)
    n = int(round((hi - lo) / step))
    edge = lambda k: F.lit(lo + 1e-6) + F.lit(step) * k
    guess = F.floor((F.col("dist") - F.lit(lo + 1e-6)) / F.lit(step)).cast("int")
    bins = F.filter(F.transform(F.array(guess - 1, guess, guess + 1), lambda k: F.when((k >= 0) & (k < n) & (F.col("dist") >= edge(k)) & (F.col("dist") <= edge(k + 1)), k + 1)), lambda k: k.isNotNull())
    all_bins = F.concat(F.when(F.col("dist") <= lo, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), bins, F.when(F.col("dist") > hi, F.array(F.lit(n + 1))).otherwise(F.array().cast("array<int>")))
    counts = dist.select(weight.alias("_w"), F.explode(all_bins).alias("bin")).groupBy("bin").agg(F.sum("_w").alias("n"))
    table = dist.sparkSession.range(n + 2).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    order = F.asc("bin") if direction == "forward" else F.desc("bin")
    return table.withColumn("cumulative", F.sum("n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def pairwise_explorer(both: DataFrame, width: float = 0.005) -> DataFrame:
    """Per query its pairs by distance class: members and mean distance."""
    return both.groupBy("q", F.floor(F.col("dist") / F.lit(width)).alias("class")).agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("dist"), 9).alias("mean_dist"))


def pairwise_explorer_of(df: DataFrame, width: float = 0.005, min_overlap: int = 300) -> DataFrame:
    """pairwise_explorer of all pairs within species, none of which leaves its tile."""
    found = tiles.classes(df, width, min_overlap).groupBy("q", "class").agg(F.sum("members").alias("members"), F.sum("total").alias("_total"))
    return found.select("q", "class", "members", F.round(F.col("_total") / F.col("members"), 9).alias("mean_dist"))


def distance_analysis(sequences: DataFrame, both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per species, per genus) means of each sequence's smallest and mean congeneric distance.

    Three stacked means; whatever has no pair is left out of the mean above it.
    """
    return _analysed(sequences, both.where("genus_q = genus_m and species_q <> species_m").groupBy("q").agg(F.min("dist").alias("smallest"), F.avg("dist").alias("mean")))


def distance_analysis_of(sequences: DataFrame, min_overlap: int = 300) -> tuple[DataFrame, DataFrame]:
    """distance_analysis of all pairs within genera, none of which leaves its tile."""
    return _analysed(sequences, tiles.congeneric(sequences, min_overlap))


def _analysed(sequences: DataFrame, cong: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = sequences.where("species is not null").select(F.col("ord").alias("q"), "species", "genus").join(cong, "q", "left")
    species = named.groupBy("genus", "species").agg(F.avg("smallest").alias("smallest"), F.avg("mean").alias("mean"))
    genus = species.groupBy("genus").agg(F.avg("smallest").alias("smallest"), F.avg("mean").alias("mean"), F.count("mean").alias("species_compared"))
    tidy = lambda d: d.withColumns({k: F.round(k, 9) for k in ("smallest", "mean")})
    return tidy(species), tidy(genus)


def one_per_species(df: DataFrame) -> DataFrame:
    """The longest sequence of each species; of equal ones the first."""
    best = F.max_by(F.struct("ord", "title", "seq", "actual_length"), F.struct("actual_length", F.negative("ord"))).alias("b")
    return df.where("species is not null").groupBy("species").agg(best).select("species", "b.*")
