"""Annotated flat files: loci, sections, features, and the subsequences that features name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import complement
from ..operators.intervals import overlap_join, overlaps
from ..operators.storage import store
from .scan import FlatFile, records, scan


def read_flatfile(spark: SparkSession, path: str | list[str], folder: bool = False) -> DataFrame:
    """file, locus_id, name, accession, gi, sections (array of name and value), origin; one row per //.

    Files may be of any size: records are cut and numbered over splits; with `folder`, the parts in a folder are one file.
    """
    found = records(scan(spark, path, FlatFile(), folder))
    return _parsed(found.select("file", F.col("record").alias("locus_id"), F.concat("text", F.lit("\n")).alias("t")).where(F.col("t").rlike(r"\S")))


def parse_flatfile(files: DataFrame) -> DataFrame:
    """The same from file and text."""
    return _parsed(files.select("file", F.posexplode(F.split("text", r"(?m)^//[^\n]*\n?")).alias("locus_id", "t")).where(F.col("t").rlike(r"\S")))


def _parsed(loci: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("t", F.lit(r"(?m)^([A-Z][^\n]*(?:\n(?![A-Z])[^\n]*)*)"), F.lit(1))
    sections = F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_replace(s, r"^\S+", "")).alias("value")))
    value = lambda name: F.get(F.filter("sections", lambda s: s["name"] == name), 0)["value"]
    out = loci.select("file", F.col("locus_id").cast("long").alias("locus_id"), sections.alias("sections"))
    words = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return out.select(
        "file", "locus_id", "sections", words(value("DEFINITION")).alias("definition"), words(value("ACCESSION")).alias("accession"),
        F.nullif(F.regexp_extract(value("VERSION"), r"GI:(\d+)", 1), F.lit("")).alias("gi"),
        F.coalesce(words(value("DEFINITION")), words(value("ACCESSION")), F.lit("Unnamed locus")).alias("name"),
        F.upper(F.regexp_replace(value("ORIGIN"), r"[\d\s]", "")).alias("origin"),
    )


def list_sections(loci: DataFrame) -> DataFrame:
    return loci.select("file", "locus_id", "name", F.posexplode("sections").alias("place", "s")).select("file", "locus_id", "name", "place", F.col("s.name").alias("section"), F.col("s.value").alias("value"))


def parse_location(text: Column) -> Column:
    """Intervals of a location (from, to, complement, open ends); null where it can't be read.

    A join within a complement isn't read.
    """
    plain = F.regexp_replace(text, r"\s", "")
    part = r"(complement\(<?\d+(?:\.\.>?\d+)?\)|<?\d+(?:\.\.>?\d+)?)"
    valid = plain.rlike(rf"^(?:{part}|(?:join|order)\({part}(?:,{part})*\))$")
    number = lambda p, i: F.regexp_extract(p, r"<?(\d+)(?:\.\.>?(\d+))?", i)
    one = lambda p: F.struct(
        number(p, 1).cast("int").alias("from"), F.coalesce(F.nullif(number(p, 2), F.lit("")), number(p, 1)).cast("int").alias("to"),
        p.startswith("complement").alias("complement"), p.contains("<").alias("from_ext"), p.contains(">").alias("to_ext"),
    )
    return F.when(valid, F.transform(F.regexp_extract_all(plain, F.lit(part), F.lit(1)), one))


def explode_features(loci: DataFrame) -> DataFrame:
    """One row per feature: its name, location text, location, and qualifiers (key -> values)."""
    table = F.get(F.filter("sections", lambda s: s["name"] == "FEATURES"), 0)["value"]
    rows = loci.select("file", "locus_id", "name", "gi", F.regexp_replace(table, r"^[^\n]*", "").alias("t"))
    found = F.regexp_extract_all("t", F.lit(r"(?m)^ {1,10}(\S[^\n]*(?:\n {11,}[^\n]*)*)"), F.lit(1))
    each = rows.select("file", "locus_id", F.col("name").alias("definition"), "gi", F.posexplode(found).alias("feature_id", "f"))
    flat = F.regexp_replace("f", r"\n\s+", " ")
    pairs = F.regexp_extract_all(flat, F.lit(r'(/[\w-]+(?:=(?:"(?:[^"]|"")*"|[^\s/][^\s]*))?)'), F.lit(1))
    keys = F.array_distinct(F.transform(pairs, lambda p: F.regexp_extract(p, r"^(/[\w-]+)", 1)))
    value = lambda p: F.regexp_replace(F.regexp_replace(p, r"^/[\w-]+=?", ""), r'^"|"$', "")
    qualifiers = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: F.regexp_extract(p, r"^(/[\w-]+)", 1) == k), value))))
    where = F.regexp_replace(F.regexp_extract(flat, r"^\S+\s+([^/]*)", 1), r"\s", "")
    return each.select("file", "locus_id", F.col("feature_id").cast("long").alias("feature_id"), F.regexp_extract(flat, r"^(\S+)", 1).alias("feature"), where.alias("location_text"), parse_location(where).alias("location"), qualifiers.alias("qualifiers"), "definition", "gi")


def features_by_gene(features: DataFrame) -> DataFrame:
    """Features with their group: `gene X-feature`, else `product X-feature`, else misc."""
    gene, product = F.col("qualifiers")["/gene"], F.col("qualifiers")["/product"]
    label = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind} "), v, F.lit("-"), F.col("feature")))
    return features.withColumn("gene", F.explode(F.coalesce(label("gene", gene), label("product", product), F.array(F.lit("misc")))))


def extract_features(features: DataFrame, loci: DataFrame) -> DataFrame:
    """The feature's bases: its intervals in order, complements turned around."""
    cut = lambda i: F.substring(F.col("origin"), i["from"], i["to"] - i["from"] + 1)
    seq = F.array_join(F.transform("location", lambda i: F.when(i["complement"], F.reverse(complement(cut(i)))).otherwise(cut(i))), "")
    joined = features.where("location is not null").join(loci.select("file", "locus_id", "origin", "name"), ["file", "locus_id"])
    title = F.concat_ws(" ", F.concat(F.lit("gi|"), F.col("gi"), F.lit("|")), "name", F.concat(F.lit("("), F.col("feature"), F.lit(")")))
    keep = [c for c in ("gene",) if c in features.columns]
    return joined.select("file", "locus_id", "feature_id", "feature", *keep, title.alias("title"), seq.alias("seq"))


def features_intersect(features: DataFrame) -> DataFrame:
    """Pairs of features of a locus of which two intervals share a position."""
    iv = features.select("file", "locus_id", "feature_id", F.explode("location").alias("i")).select("file", "locus_id", "feature_id", "i.from", "i.to")
    # only features of several intervals can meet more than once; pairs of the others need not be told apart
    on, key = ["file", "locus_id"], ["file", "locus_id", "feature_id"]
    iv = store(iv)
    many = store(iv.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))
    one, several = iv.join(many, key, "left_anti"), iv.join(many, key, "left_semi")
    pair = lambda met, a, b: met.select("x.file", "x.locus_id", a.alias("a"), b.alias("b"))
    x, y = F.col("x.feature_id"), F.col("y.feature_id")
    again = pair(overlap_join(several, iv, on).where(x != y), F.least(x, y), F.greatest(x, y)).distinct()
    return pair(overlaps(one, on, "feature_id"), x, y).unionByName(again)


def combine_features(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_minimum_species(features: DataFrame, least: int) -> DataFrame:
    """Features of genes that at least so many species have (needs gene and species)."""
    enough = features.groupBy("gene").agg(F.count_distinct("species").alias("n")).where(F.col("n") >= least)
    return features.join(enough, "gene", "left_semi")


def restore_titles(aligned: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aligned rows with their titles back, originals that were not met).

    Aligned titles are seq<id>: the GI of the original, or the number in its [uniqueid:...].
    """
    key = F.coalesce(F.nullif(F.regexp_extract("title", r"gi\|(\d+)[|:]", 1), F.lit("")), F.nullif(F.regexp_extract("title", r"\[uniqueid:(\w+)\]", 1), F.lit("")))
    known = originals.select(F.col("title").alias("_t"), key.alias("_k")).where("_k is not null").withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy("_t"))).where("_n = 1").drop("_n")
    rows = aligned.withColumn("_k", F.nullif(F.regexp_extract("title", r"seqU?(\w+)", 1), F.lit("")))
    restored = rows.join(known, "_k", "left").withColumn("title", F.coalesce("_t", "title")).drop("_t", "_k")
    return restored, known.join(rows.select("_k"), "_k", "left_anti").select(F.col("_t").alias("title"))
