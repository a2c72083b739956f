"""Document fingerprints from spot signatures.

A spot is a common word (the anchor) with the chain of content words that follow it.  The set of a
text's spots is its fingerprint.  Sets are partitioned by their number of spots, since two sets
whose sizes differ by more than the threshold allows cannot be alike, and only a short prefix of
the rarest spots has to be joined before Jaccard is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import body, table

# Very common function words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is that for it was with as on be by at this from are an or "
    "de la le et les des un une en du que dans qui pour est par sur au plus "
    "der die und den von zu das mit sich ein eine auf ist im dem nicht für er es "
    "el los las y del se con por una su para al lo como"
).split()
CHAIN = 3


def spot_set(text: Column) -> Column:
    """Sorted distinct spots of a text as 8 hexadecimal digits each; empty for a text without words.

    The start of a text is an anchor as well, so that every text with a word has a spot.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(ANCHORS), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    whole = F.struct(words.alias("w"), F.filter(words, lambda w: ~w.isin(ANCHORS)).alias("c"), at.alias("at"))

    def spots(x: Column) -> Column:
        chains = F.transform(x["at"], lambda p, j: F.concat_ws(" ", F.get(x["w"], p), F.slice(x["c"], p - j + 1, CHAIN)))
        first = F.concat_ws(" ", F.lit("^"), F.slice(x["w"], 1, CHAIN))
        chains = F.when(F.size(x["w"]) > 0, F.concat(F.array(first), chains)).otherwise(F.array().cast("array<string>"))
        return F.array_sort(F.array_distinct(F.transform(chains, lambda s: F.substring(F.md5(s.cast("binary")), 1, 8))))

    return F.element_at(F.transform(F.array(whole), spots), 1)


def length_partition(size: Column, threshold: float = 0.8) -> Column:
    """Sets in partitions that are more than one apart differ too much in size to be alike."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two spot sets; 0 without a comparison where their sizes rule `least` out.

    Two empty sets are alike (1), an empty and a filled one are not (0).
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small < F.lit(least) * large), F.lit(0.0))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def with_next(docs: DataFrame, block_bits: int = 7) -> DataFrame:
    """doc_id, text and next_text: the text of the document with the next smaller doc_id.

    The document with the smallest id is followed by the one with the largest.  Ids are dealt out
    in blocks of 2**block_bits, so that each text is shuffled once; only the first document of a
    block looks for its follower in another block, through a table of blocks and, above it, one of
    superblocks.  Rows with equal ids are ordered by text; rows without an id come last, in blocks by a
    hash of their text.
    """
    docs = docs.select("doc_id", body().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    block = F.coalesce(F.shiftright("doc_id", block_bits), F.lit(-(2**62)) + F.pmod(F.xxhash64("text"), F.lit(1 << 10)))
    rows = W.partitionBy("_b").orderBy(*order)
    inside = docs.withColumn("_b", block).withColumn("_next", F.lead("text").over(rows)).withColumn("_n", F.row_number().over(rows))
    # the text that leads each block; the window's shuffle is used again
    heads = inside.where("_n = 1").select("_b", F.col("text").alias("_head"))
    names = docs.select(block.alias("_b")).distinct().withColumn("_s", F.shiftright("_b", 10))
    names = names.withColumn("_to", F.lag("_b").over(W.partitionBy("_s").orderBy("_b")))
    tops = names.groupBy("_s").agg(F.max("_b").alias("_top"))
    tops = tops.withColumn("_before", F.coalesce(F.lag("_top").over(W.orderBy("_s")), F.max("_top").over(W.orderBy("_s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    follow = names.join(tops.select("_s", "_before"), "_s").select("_b", F.coalesce("_to", "_before").alias("_to"))
    follow = follow.join(heads.withColumnRenamed("_b", "_to"), "_to").select("_b", "_head")
    last = inside.where(F.col("_next").isNull()).join(follow, "_b").select("doc_id", "text", F.col("_head").alias("next_text"))
    return inside.where(F.col("_next").isNotNull()).select("doc_id", "text", F.col("_next").alias("next_text")).unionByName(last)


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, similarity) of doc_ids, a < b, whose spot sets have at least that Jaccard.

    Texts with equal sets are one class, represented by their smallest id; members follow it with
    similarity 1.  Classes are joined on the rarest spots of each (their prefix), within equal or
    neighbouring length partitions, and compared with the size bound first.  Texts without spots
    take no part.
    """
    sets = docs.select("doc_id", spot_set(body()).alias("spots")).where(F.size("spots") > 0)
    classes = sets.groupBy("spots").agg(F.min("doc_id").alias("rep"))
    members = sets.join(classes, "spots").where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    spots = classes.select("rep", F.size("spots").alias("n"), F.explode("spots").alias("s"))
    often = spots.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = spots.join(often, "s").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("r"))
    # spots that occur once cannot be shared, but count in the size that sets the prefix
    keep = F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.size("r")))
    prefix = ranked.select("rep", "n", length_partition(F.col("n"), threshold).alias("p"), F.explode(F.slice("r", 1, keep.cast("int"))).alias("x")).select("rep", "n", "p", F.col("x.s").alias("s"))
    left = prefix.select(F.col("rep").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(F.col("p") - 1, "p", F.col("p") + 1)).alias("p"))
    right = prefix.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "s", "p")
    cand = left.join(right, ["s", "p"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))).select("a", "b").distinct()
    with_sets = cand.join(classes.select(F.col("rep").alias("a"), F.col("spots").alias("sa")), "a").join(classes.select(F.col("rep").alias("b"), F.col("spots").alias("sb")), "b")
    between = with_sets.select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), threshold).alias("similarity")).where(F.col("similarity") >= threshold)
    return between.unionByName(members)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its half-edited text and its follower, with their likeness."""
    pairs = with_next(table(spark, sf_dir, "documents"))
    half = F.floor(F.length("text") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    sets = pairs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spot_set(F.col("text")).alias("s"), spot_set(F.col("edited")).alias("e"), spot_set(F.col("next_text")).alias("x"),
    )
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("s", ",").alias("fingerprint"), F.array_join("e", ",").alias("edited_fingerprint"),
        F.round(pruned_jaccard(F.col("s"), F.col("e")), 9).alias("near_edited"), F.round(pruned_jaccard(F.col("s"), F.col("x")), 9).alias("near_next"),
        F.size("s").alias("n_spots"), length_partition(F.size("s")).alias("length_partition"),
    )


_LIST = ", ".join(f"'{w}'" for w in dict.fromkeys(ANCHORS))


def _sql_spots(text: str) -> str:
    w = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"(SELECT CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(list_concat(['^ ' || array_to_string(w[1:{CHAIN}], ' ')], list_transform(a, lambda p, j: trim(w[p] || ' ' || array_to_string(c[p - j + 1:p - j + {CHAIN}], ' ')))), lambda s: left(md5(s), 8)))) END FROM (SELECT w, list_filter(w, lambda x: x NOT IN ({_LIST})) AS c, list_filter(list_transform(w, lambda x, i: CASE WHEN x IN ({_LIST}) THEN i ELSE 0 END), lambda i: i > 0) AS a FROM (SELECT {w} AS w)))"


SQL = f"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM documents
), e AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n
), f AS (
  SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_sql_spots('text')} AS s, {_sql_spots('edited')} AS e, {_sql_spots('next_text')} AS x FROM e
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(s, ',') AS fingerprint, array_to_string(e, ',') AS edited_fingerprint,
       round(CASE WHEN greatest(len(s), len(e)) = 0 THEN 1.0 WHEN least(len(s), len(e)) = 0 THEN 0.0 ELSE len(list_intersect(s, e))::DOUBLE / (len(s) + len(e) - len(list_intersect(s, e))) END, 9) AS near_edited,
       round(CASE WHEN greatest(len(s), len(x)) = 0 THEN 1.0 WHEN least(len(s), len(x)) = 0 THEN 0.0 ELSE len(list_intersect(s, x))::DOUBLE / (len(s) + len(x) - len(list_intersect(s, x))) END, 9) AS near_next,
       len(s)::INTEGER AS n_spots, floor(ln(greatest(len(s), 1)) / {-math.log(0.8)!r} + 1e-9)::INTEGER AS length_partition
FROM f
"""
