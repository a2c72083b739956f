"""Exact duplicates through a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text.  A batch is first
aggregated to one row per digest, so a text with any number of copies costs one row per task;
what the index lacks is found by a sort-merge anti-join that reads the buckets in place, and is
appended.  Only digests and ids are ever shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, body, fresh_table, store, table


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the UTF-8 text, unchanged; a null text counts as empty."""
    return docs.select("doc_id", F.sha2(body().cast("binary"), 256).alias("text_sha256"))


def group_digests(hashed: DataFrame) -> DataFrame:
    """One row per digest: the id that stays and the number of rows (combined before the shuffle)."""
    return hashed.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """A table of digests, bucketed and sorted by digest, that grows batch by batch.

    A batch that repeats digests of the index adds nothing for them: the row that was there first
    stays.  Within a batch the row with the largest doc_id stays.  Without a name the index is an
    intermediate of this session (see drop_intermediates).
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or fresh_table("digest_index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS")
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        self.buckets = int(described["Num Buckets"])

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks, by an anti-join that reads its buckets in place.

        Groups are stored first: Spark would else move the anti-join before the aggregate, to single rows.
        """
        return store(groups, "groups").join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Adds groups that the index lacks."""
        writer = groups.select("text_sha256", "keep_id", "group_size").repartition(self.buckets, "text_sha256").write
        writer.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Deduplicates a batch against the index and within itself, appends it and returns its new rows.

        A batch that is added once more has no new rows; a doc_id that comes again with another text
        is judged by its text.
        """
        new = store(self.lacking(group_digests(digests(docs))), "new_digests")
        self.append(new)
        new = new.select(F.col("keep_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
        same = docs["doc_id"].eqNullSafe(new["_keep"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256) == new["_sha"])
        return docs.join(new, same, "left_semi")


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Every row of docs with the row that stays for its text.

    Columns doc_id, keep_id, group_size, kept, text_sha256.  Of equal texts the row with the
    largest doc_id stays; a null doc_id only stays where no other row has the text; rows that
    repeat both doc_id and text cannot be told apart and share their verdict.  Empty texts are
    equal to each other and to nulls.  An empty table gives no rows; other columns are ignored.

    With an index that has rows, a text that was there first keeps the row that stayed then, and
    group_size counts the rows of the batch that brought the text and those of docs.  Docs that
    were added before count as rows of their own.

    Rows are joined with the index in its buckets.  Texts with more copies than half a bucket's fair
    share of rows are at most two for each bucket: these are broadcast, and their rows go to buckets
    at random.
    """
    hashed = digests(docs)
    if index is None:
        index = DigestIndex(docs.sparkSession)
        index.append(index.lacking(group_digests(hashed)))
        groups = index.read()
    else:
        own = store(group_digests(hashed), "own_digests")
        new = store(index.lacking(own), "new_digests")
        met = own.join(new.select("text_sha256"), "text_sha256", "left_anti").select("text_sha256", F.col("group_size").alias("_more"))
        index.append(new)
        counted = F.col("group_size") + F.coalesce("_more", F.lit(0))
        groups = index.read().join(store(met, "met_digests"), "text_sha256", "left").select("text_sha256", "keep_id", counted.alias("group_size"))
    share = (groups.agg(F.sum("group_size")).first()[0] or 0) / (2 * index.buckets)
    often = groups.where(F.col("group_size") > F.lit(share)).select(F.col("text_sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    rows = hashed.join(F.broadcast(often), F.col("text_sha256") == F.col("_sha"), "left")
    rows = rows.withColumn("_key", F.when(F.col("_sha").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))))
    known = groups.select(F.col("text_sha256").alias("_own"), "keep_id", "group_size").hint("merge")
    joined = rows.join(known, F.col("_key") == F.col("_own"), "left")
    keep = F.when(F.col("_sha").isNull(), F.col("keep_id")).otherwise(F.col("_keep"))
    size = F.when(F.col("_sha").isNull(), F.col("group_size")).otherwise(F.col("_size"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id has; all columns stay.

    The rows to drop are known by id and digest, so a doc_id that comes with several texts only
    loses the copies.  Texts are not shuffled while the dropped ids are proven few enough to send.
    """
    gone = store(exact_groups(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "gone")
    few = 96 * gone.count() <= BROADCAST_BYTES
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256) == gone["_sha"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
