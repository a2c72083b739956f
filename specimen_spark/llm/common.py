"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one batch to Python holds at most; texts may be long, and workers keep what they once took.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_made: list[tuple[str, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark sends to Python at a time, where the session leaves the default of 10 000 rows."""
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; a cluster has none that all share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return os.path.dirname(current.get().rstrip("/")) or current.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a copy in the shared folder, which outlives any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


def fresh_table(name: str) -> str:
    name = f"{name}_{uuid.uuid4().hex}"
    _made.append(("table", name))
    return name


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Writes df once as a table in the shared folder, bucketed by key: later joins by key don't move its rows."""
    spark, name = df.sparkSession, fresh_table(name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", fresh_path(spark, name)).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes the intermediate files and tables of this session's operators.

    Results are lazy and read them: write results first.
    """
    while _made:
        kind, name = _made.pop()
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder once and reads it back: its lineage ends there, as in cut().

    Unlike a checkpoint, it is computed once even where no shuffle precedes it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that take at most so many bytes in all are broadcast to pick rows; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def pick(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is among ids (one column of that name, one row per id)."""
    if 16 * ids.count() <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return rows.join(ids, key, "left_semi")


def zipped(a: np.ndarray) -> bytes:
    return zstandard.compress(a.tobytes(), 1)


def unzipped(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def give_back() -> None:
    """Returns memory that Python, Arrow and the C library hold but don't use to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back when its task ends: workers live on between tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
