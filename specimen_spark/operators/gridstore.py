"""A stored grid: a bucketed base, deltas of later batches, and a merge when it is read.

Adding rows to a grid costs what the rows cost: a batch writes its delta and nothing else, and a batch
that is written again replaces itself.  Reading folds the deltas first and then joins them with the
base in its buckets, so that the base is never shuffled.  Compacting makes a new base of all batches so
far; older bases and deltas stay, so that any version can be read.

The rules are those of filling a grid: the first row fixes a locus' length and others of another
length are refused; of rows of one cell the longest stays, of equal ones the last; a mark that
cancels a cell toggles it, and goes when another row takes the cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import hadoop_path

_CELL = "locus string, taxon string, batch long, ord long, seq string, actual_length int, cancelled boolean"
_DELTA = f"{_CELL}, toggles long"
_LENGTHS = "locus string, length int"


class GridStore:
    """The grid under a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, number: int) -> str:
        return f"grid_{hashlib.md5(self.path.encode()).hexdigest()}_{number}"

    def _numbers(self, kind: str) -> list[int]:
        """The finished batches or bases."""
        fs, at = hadoop_path(self.spark, f"{self.path}/{kind}")
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at)]
        done = [p for p in found if fs.exists(hadoop_path(self.spark, f"{p}/_SUCCESS")[1])]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Writes rows (locus, taxon, ord, seq) as a batch; rows without a base are left out."""
        made = rows.select("locus", "taxon", F.lit(batch).cast("long").alias("batch"), F.col("ord").cast("long").alias("ord"), "seq", F.regexp_count("seq", F.lit("[^_?]")).alias("actual_length"), (F.coalesce("cancelled", F.lit(False)) if "cancelled" in rows.columns else F.lit(False)).alias("cancelled"), F.lit(0).cast("long").alias("toggles"))
        made.where("actual_length > 0").write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def cancel(self, cells: DataFrame, batch: int) -> None:
        """Toggles cells (locus, taxon) as a batch of its own; a null locus means the taxon at every locus."""
        own = cells.select("locus", "taxon").distinct()
        rows = own.select("locus", "taxon", F.lit(batch).cast("long").alias("batch"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("seq"), F.lit(None).cast("int").alias("actual_length"), F.lit(None).cast("boolean").alias("cancelled"), F.lit(1).cast("long").alias("toggles"))
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def _base(self, number: int) -> tuple[DataFrame, DataFrame]:
        """(cells, lengths of loci) of a base, or of none where number is -1."""
        if number < 0:
            return self.spark.createDataFrame([], _CELL), self.spark.createDataFrame([], _LENGTHS)
        name = self._table(number)
        cells = f"{self.path}/base/version={number}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_CELL}) USING parquet CLUSTERED BY (locus, taxon) SORTED BY (locus, taxon) INTO {self.buckets} BUCKETS LOCATION '{cells}'")
        return self.spark.table(name), self.spark.read.schema(_LENGTHS).parquet(f"{self.path}/lengths/version={number}")

    def _parts(self, version: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(cells of the newest base, its lengths, deltas behind it) up to a version."""
        bases = [b for b in self._numbers("base") if version is None or b <= version]
        base = max(bases, default=-1)
        batches = [b for b in self._numbers("delta") if b > base and (version is None or b <= version)]
        paths = [f"{self.path}/delta/batch={b}" for b in batches]
        deltas = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        return *self._base(base), deltas

    def _lengths(self, known: DataFrame, deltas: DataFrame) -> DataFrame:
        """The length that each locus has: that of the base, or of the first row; one row for each locus."""
        first = deltas.where("seq is not null").groupBy("locus").agg(F.min_by(F.length("seq"), F.struct("batch", "ord", "taxon", "seq")).alias("_new"))
        return known.join(first, "locus", "full").select("locus", F.coalesce("length", "_new").alias("length"))

    def read(self, version: int | None = None) -> DataFrame:
        """The grid as of a batch, or now: locus, taxon, ord, seq, actual_length, cancelled."""
        return self._merged(version)[0].drop("batch")

    def _merged(self, version: int | None) -> tuple[DataFrame, DataFrame]:
        base, known, deltas = self._parts(version)
        lengths = self._lengths(known, deltas)
        rows = deltas.where("seq is not null").join(lengths, "locus").where(F.length("seq") == F.col("length"))
        cell = F.struct("batch", "ord", "seq", "actual_length", "cancelled")
        new = rows.groupBy("locus", "taxon").agg(F.max_by(cell, F.struct("actual_length", "batch", "ord", "seq")).alias("_n"))
        # the deltas are few rows beside the base, which is joined where its buckets lie
        met = base.withColumn("_b", cell).select("locus", "taxon", "_b").join(new, ["locus", "taxon"], "full")
        wins = F.col("_b").isNull() | (F.col("_n.actual_length") >= F.col("_b.actual_length"))
        best = met.select("locus", "taxon", F.when(F.col("_n").isNotNull() & wins, F.col("_n")).otherwise(F.col("_b")).alias("c")).select("locus", "taxon", "c.*")
        marks = deltas.where("toggles > 0").select("locus", "taxon", F.col("batch").alias("_at"))
        one = marks.where("locus is not null").groupBy("locus", "taxon").agg(F.array_sort(F.collect_list("_at")).alias("_one"))
        whole = marks.where("locus is null").groupBy("taxon").agg(F.array_sort(F.collect_list("_at")).alias("_row"))
        marked = best.join(one, ["locus", "taxon"], "left").join(whole, "taxon", "left")
        # a cell that both kinds name in one batch is toggled once
        later = lambda c: F.filter(F.coalesce(c, F.array().cast("array<bigint>")), lambda at: at > F.col("batch"))
        n = F.size(F.array_union(later("_one"), later("_row")))
        cancelled = F.when(n % 2 == 1, ~F.col("cancelled")).otherwise(F.col("cancelled"))
        return marked.select("locus", "taxon", "batch", "ord", "seq", "actual_length", cancelled.alias("cancelled")), lengths

    def refused(self, version: int | None = None) -> DataFrame:
        """(locus, taxon, batch, ord): rows behind the newest base whose length isn't that of their locus."""
        _, known, deltas = self._parts(version)
        rows = deltas.where("seq is not null").join(self._lengths(known, deltas), "locus")
        return rows.where(F.length("seq") != F.col("length")).select("locus", "taxon", "batch", "ord")

    def compact(self) -> int:
        """Makes a base of all batches there are, and says which is the last in it."""
        last = max(self._numbers("delta"), default=-1)
        if last < 0 or last in self._numbers("base"):
            return last
        grid, lengths = self._merged(last)
        # a mark in the base is final: what toggles the cell later has a later batch
        lengths.write.mode("overwrite").parquet(f"{self.path}/lengths/version={last}")
        name = self._table(last)
        settled = grid.select("locus", "taxon", F.lit(last).cast("long").alias("batch"), "ord", "seq", "actual_length", "cancelled")
        made = settled.repartition(self.buckets, "locus", "taxon").write.format("parquet").option("path", f"{self.path}/base/version={last}")
        made.bucketBy(self.buckets, "locus", "taxon").sortBy("locus", "taxon").mode("overwrite").saveAsTable(name)
        return last
