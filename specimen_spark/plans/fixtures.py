"""Sequences and grids derived from the driver's tables, as DataFrames and as SQL for the oracle.

Every vector of `embeddings` becomes an aligned sequence of 64 positions whose bases depend on the
label, with ambiguities, inner and outer gaps, missing positions, mislabelled and unnamed rows.  Ragged
ones have 64 to 544 positions, or 30, and some share a title.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import mark_external, parse_titles, profile

GENERA = ("Musca", "Apis", "Culex")
EPITHETS = ("prima", "secunda", "tertia", "quarta", "quinta", "sexta", "septima", "octava", "nona", "decima")
MIN_OVERLAP = 40
LOCI = 4
LOCUS_LENGTH = 16


RAGGED = "if(v % 13 = 0, 30, 64 + (v % 5) * 120)"
#: The length of sequence v.
SIZE: ContextVar[str] = ContextVar("SIZE", default="64")


def sized(f: Callable[[SparkSession, str], DataFrame], size: str) -> Callable[[SparkSession, str], DataFrame]:
    """The same query over sequences of other lengths."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = SIZE.set(size)
        try:
            return f(spark, sf_dir)
        finally:
            SIZE.reset(before)

    return run


def ragged(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return sized(f, RAGGED)


#: Vectors that are dealt out to all cores where few tasks read them.
SPREAD = 20_000


def _spread(e: DataFrame) -> DataFrame:
    """A large table in few files is read by few tasks, and a sequence takes far longer to make than its vector to move."""
    cores = e.sparkSession.sparkContext.defaultParallelism
    return e.repartition(2 * cores) if e.rdd.getNumPartitions() < cores and e.count() >= SPREAD else e


def raw_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, title and unnormalised seq of every vector."""
    e = _spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(F.col("vec_id").alias("v"), F.col("label").cast("long").alias("l"), "embedding")
    size = SIZE.get()
    letter = f"""transform(sequence(0, cast({size} as int) - 1), p -> case
        when (v * 5 + p * 11) % 37 = 0 then '?'
        when (v + p * 13) % 61 = 0 or p < v % 5 or p >= {size} - v % 7 then '-'
        when (v * 3 + p * 17) % 41 = 0 then 'N'
        when (v * 11 + p * 3) % 43 = 0 then 'R'
        else substring('ACTG', cast((p * p * 3 + p * 5 + (l % 3) * (p div 2 + 1) + if((p * 7 + l * 11) % 9 = 0, 1, 0)
             + if(cast(embedding[p % 64] as double) > 0.25, 1, 0) + if(cast(embedding[p % 64] as double) > 0.3, 1, 0)) % 4 as int) + 1, 1) end)"""
    shown = "if(v % 31 = 0, (l + 3) % 10, l)"
    genus = f"element_at(array{GENERA}, cast(({shown}) % 3 as int) + 1)"
    epithet = f"element_at(array{EPITHETS}, cast({shown} as int) + 1)"
    twin = f"when v % 29 = 1 then concat({genus}, ' ', {epithet})" if size == RAGGED else ""
    title = f"case {twin} when v % 50 = 49 then concat('gi|', v, '| unnamed') else concat('gi|', v, '| ', {genus}, ' ', {epithet}, if(v % 4 = 0, concat(' (family: ', {genus}, 'idae)'), '')) end"
    return e.select(F.col("v").alias("ord"), F.expr(title).alias("title"), F.expr(f"array_join({letter}, '')").alias("seq"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed, normalised and profiled sequences."""
    raw = raw_sequences(spark, sf_dir)
    return profile(parse_titles(raw.withColumn("seq", mark_external(F.col("seq")))))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locus, taxon, ord, seq, actual_length, cancelled: four loci of 16 positions, some cells absent."""
    s = sequences(spark, sf_dir).select("ord", "title", "seq")
    cells = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(LOCI - 1)))).where("pmod(ord + k, 6) <> 0")
    seq = F.expr(f"substring(seq, k * {LOCUS_LENGTH} + 1, {LOCUS_LENGTH})")
    out = cells.select(F.concat(F.lit("locus"), F.col("k").cast("string")).alias("locus"), F.col("title").alias("taxon"), "ord", seq.alias("seq"))
    return out.withColumn("actual_length", F.regexp_count("seq", F.lit("[^_?]"))).where("actual_length > 0").withColumn("cancelled", F.expr("pmod(ord, 17) = 3"))


# the same in SQL --------------------------------------------------------------------------------

SQL_SEQUENCES = f"""
raw AS MATERIALIZED (
  SELECT v AS ord, CASE WHEN v % 50 = 49 THEN 'gi|' || v || '| unnamed' ELSE 'gi|' || v || '| ' || g || ' ' || ep || CASE WHEN v % 4 = 0 THEN ' (family: ' || g || 'idae)' ELSE '' END END AS title,
    CASE WHEN v % 50 = 49 THEN NULL ELSE g END AS genus, CASE WHEN v % 50 = 49 THEN NULL ELSE ep END AS species_epithet,
    CASE WHEN v % 50 = 49 THEN NULL ELSE g || ' ' || ep END AS species, v::VARCHAR AS gi, CASE WHEN v % 50 <> 49 AND v % 4 = 0 THEN g || 'idae' END AS family, v % 50 = 49 AS warning,
    array_to_string(list_transform(range(64), lambda p: CASE WHEN (v * 5 + p * 11) % 37 = 0 THEN '?' WHEN (v + p * 13) % 61 = 0 OR p < v % 5 OR p >= 64 - v % 7 THEN '-'
      WHEN (v * 3 + p * 17) % 41 = 0 THEN 'N' WHEN (v * 11 + p * 3) % 43 = 0 THEN 'R'
      ELSE substr('ACTG', ((p * p * 3 + p * 5 + (l % 3) * (p // 2 + 1) + (CASE WHEN (p * 7 + l * 11) % 9 = 0 THEN 1 ELSE 0 END)
        + (CASE WHEN e[p + 1]::DOUBLE > 0.25 THEN 1 ELSE 0 END) + (CASE WHEN e[p + 1]::DOUBLE > 0.3 THEN 1 ELSE 0 END)) % 4)::INTEGER + 1, 1) END), '') AS plain
  FROM (SELECT vec_id AS v, label::BIGINT AS l, embedding AS e, ({list(GENERA)!r})[((CASE WHEN vec_id % 31 = 0 THEN (label + 3) % 10 ELSE label END) % 3) + 1] AS g,
          ({list(EPITHETS)!r})[(CASE WHEN vec_id % 31 = 0 THEN (label + 3) % 10 ELSE label END) + 1] AS ep FROM embeddings)
), s AS MATERIALIZED (
  SELECT * EXCLUDE (plain, head, tail), translate(head, '-', '_') || substr(plain, length(head) + 1, length(plain) - length(head) - length(tail)) || translate(tail, '-', '_') AS seq
  FROM (SELECT *, regexp_extract(plain, '^[-?]*') AS head, regexp_extract(plain, '[-?]*$') AS tail FROM raw)
)"""

#: One row per position, with its class: base mask m, inner gap i, purine p, pyrimidine y.
SQL_CHARS = """
c AS MATERIALIZED (
  SELECT ord, species, genus, species_epithet, title, q AS pos, ch,
    (CASE ch WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'T' THEN 4 WHEN 'G' THEN 8 WHEN 'R' THEN 9 WHEN 'N' THEN 15 ELSE 0 END)::INTEGER AS m, ch = '-' AS i, ch IN ('A', 'G', 'R') AS p, ch IN ('C', 'T', 'Y') AS y
  FROM (SELECT *, unnest(range(64)) AS q, substr(seq, unnest(range(64)) + 1, 1) AS ch FROM s)
)"""

#: Valid pairs by the uncorrected method.
SQL_PAIRS = f"""
pr AS MATERIALIZED (
  SELECT a, b, species_a, species_b, genus_a, genus_b, twins, overlap, 1.0::DOUBLE - same::DOUBLE / overlap AS dist, floor((1.0::DOUBLE - same::DOUBLE / overlap) * 100000)::BIGINT AS bucket
  FROM (SELECT x.ord AS a, y.ord AS b, any_value(x.species) AS species_a, any_value(y.species) AS species_b, any_value(x.genus) AS genus_a, any_value(y.genus) AS genus_b, any_value(x.title) = any_value(y.title) AS twins,
      sum(CASE WHEN (x.m > 0 AND y.m > 0) OR (x.i AND (y.m > 0 OR y.i)) OR (y.i AND x.m > 0) THEN 1 ELSE 0 END)::INTEGER AS overlap,
      sum(CASE WHEN (x.m & y.m) > 0 OR (x.i AND y.i) THEN 1 ELSE 0 END)::INTEGER AS same
    FROM c x JOIN c y ON x.pos = y.pos AND x.ord < y.ord GROUP BY x.ord, y.ord)
  WHERE overlap >= {MIN_OVERLAP}
), mir AS MATERIALIZED (
  SELECT a AS q, b AS m, species_a AS species_q, species_b AS species_m, genus_a AS genus_q, genus_b AS genus_m, overlap, dist, bucket FROM pr
  UNION ALL SELECT b, a, species_b, species_a, genus_b, genus_a, overlap, dist, bucket FROM pr
)"""

SQL_GRID = f"""
g AS MATERIALIZED (
  SELECT * FROM (SELECT 'locus' || k AS locus, title AS taxon, ord, substr(seq, k * {LOCUS_LENGTH} + 1, {LOCUS_LENGTH}) AS seq,
    length(regexp_replace(substr(seq, k * {LOCUS_LENGTH} + 1, {LOCUS_LENGTH}), '[_?]', '', 'g'))::INTEGER AS actual_length, ord % 17 = 3 AS cancelled
  FROM (SELECT *, unnest(range({LOCI})) AS k FROM s) WHERE (ord + k) % 6 <> 0) WHERE actual_length > 0
)"""


def sql(select: str, *parts: str) -> str:
    """A SELECT over s, and further parts as needed."""
    return "WITH " + ",".join([SQL_SEQUENCES, *parts]) + "\n" + select


def ragged_sql(text: str) -> str:
    """A query made by sql(), over ragged sequences."""
    size = "(CASE WHEN v % 13 = 0 THEN 30 ELSE 64 + (v % 5) * 120 END)"
    made = SQL_SEQUENCES.replace("range(64)", f"range({size}::BIGINT)").replace("p >= 64 - v % 7", f"p >= {size} - v % 7").replace("e[p + 1]", "e[p % 64 + 1]")
    made = made.replace("SELECT v AS ord, CASE WHEN", "SELECT v AS ord, CASE WHEN v % 29 = 1 THEN g || ' ' || ep WHEN").replace("THEN NULL ELSE g END AS genus", "AND v % 29 <> 1 THEN NULL ELSE g END AS genus")
    made = made.replace("THEN NULL ELSE ep END AS species_epithet", "AND v % 29 <> 1 THEN NULL ELSE ep END AS species_epithet").replace("THEN NULL ELSE g || ' ' || ep END AS species", "AND v % 29 <> 1 THEN NULL ELSE g || ' ' || ep END AS species")
    made = made.replace("v::VARCHAR AS gi", "CASE WHEN v % 29 <> 1 THEN v::VARCHAR END AS gi").replace("WHEN v % 50 <> 49 AND v % 4 = 0 THEN g || 'idae'", "WHEN v % 29 <> 1 AND v % 50 <> 49 AND v % 4 = 0 THEN g || 'idae'").replace("v % 50 = 49 AS warning", "v % 50 = 49 AND v % 29 <> 1 AS warning")
    chars = SQL_CHARS.replace("range(64)", "range(length(seq))")
    return text.replace(SQL_SEQUENCES, made).replace(SQL_CHARS, chars)
