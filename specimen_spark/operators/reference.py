"""A kept reference: bit planes of its sequences, in tiles, made once and joined by any number of queries."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import PLANES, with_planes, words_needed
from .pairs import blocks_for, measured

_META = "tiles int, words int"


class KeptReference:
    """The reference under a path that the driver and all executors share: a table bucketed by tile."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tiles, self.words = spark.read.schema(_META).parquet(f"{self.path}/meta").first()

    @classmethod
    def make(cls, reference: DataFrame, path: str, columns: int = 0) -> "KeptReference":
        """Keeps rows (ord, seq, species, genus); `columns`: the longest sequence that queries may have, if longer."""
        spark, path = reference.sparkSession, path.rstrip("/")
        tiles, words = blocks_for(reference), max(words_needed(reference), math.ceil(columns / 64))
        rows = with_planes(reference.select("ord", "seq", "species", "genus"), words).drop("seq").withColumn("tm", F.pmod(F.xxhash64("ord"), F.lit(tiles)).cast("int"))
        made = rows.repartition(tiles, "tm").write.format("parquet").option("path", f"{path}/tiles").mode("overwrite")
        made.bucketBy(tiles, "tm").sortBy("tm").saveAsTable(cls._name(path))
        spark.createDataFrame([(tiles, words)], _META).write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path)

    @staticmethod
    def _name(path: str) -> str:
        return f"reference_{hashlib.md5(path.encode()).hexdigest()}"

    def rows(self) -> DataFrame:
        kinds = ", ".join(["ord long", "species string", "genus string", *(f"{p}{w} long" for w in range(self.words) for p in PLANES), "tm int"])
        name = self._name(self.path)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({kinds}) USING parquet CLUSTERED BY (tm) SORTED BY (tm) INTO {self.tiles} BUCKETS LOCATION '{self.path}/tiles'")
        return self.spark.table(name)

    def distances(self, queries: DataFrame, method: str = "uncorrected", min_overlap: int = 300) -> DataFrame:
        """As pairs.query_distances against the kept reference, of which nothing is made again or moved.

        Queries with more positions than were kept are refused.
        """
        if words_needed(queries) > self.words:
            raise ValueError(f"queries are longer than the {64 * self.words} positions that the reference was kept for")
        q = with_planes(queries.select("ord", "seq", "species", "genus"), self.words).drop("seq")
        q = q.withColumn("tm", F.explode(F.sequence(F.lit(0), F.lit(self.tiles - 1))))
        joined = q.alias("x").join(self.rows().alias("y"), (F.col("x.tm") == F.col("y.tm")) & (F.col("x.ord") != F.col("y.ord")))
        out = measured(joined, self.words, method, min_overlap, ["x.ord as q", "y.ord as m", "x.species as species_q", "y.species as species_m", "x.genus as genus_q", "y.genus as genus_m"])
        return out.where("dist is not null").withColumn("mismatches", F.round(F.col("dist") * F.col("overlap")).cast("int"))
