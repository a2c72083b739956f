"""Streams of sequences: identification against a reference, and growing grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import add_to_grid
from ..operators.gridstore import GridStore
from ..operators.pairs import query_distances
from ..operators.ranking import best_match
from ..operators.reference import KeptReference


def identify_stream(stream: DataFrame, reference: DataFrame | KeptReference, sink: Callable[[DataFrame, int], None], threshold: float = 0.03, min_overlap: int = 300, checkpoint: str | None = None) -> StreamingQuery:
    """Best match of each arriving sequence (ord, title, seq, species, genus) in the reference.

    Queries don't depend on each other, so no state or watermark is needed.  A KeptReference is read
    in its tiles by every batch; planes of a DataFrame are made again each time.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = reference.distances(batch, min_overlap=min_overlap) if isinstance(reference, KeptReference) else query_distances(batch, reference, min_overlap=min_overlap)
        sink(best_match(batch, found, threshold), number)

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def grow_grid_stream(stream: DataFrame, path: str, locus: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Adds arriving rows (taxon, ord, seq, and locus if none is given) to the GridStore under path.

    Each batch writes its own rows and nothing else; one that is run again replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch if locus is None else batch.withColumn("locus", F.lit(locus))
        GridStore(batch.sparkSession, path).append(rows, number)

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def append_grid_stream(stream: DataFrame, path: str, locus: str, checkpoint: str | None = None) -> StreamingQuery:
    """Adds arriving rows (taxon, ord, seq) to the grid's newest version under path, one version per batch.

    Every batch reads and writes the whole grid, for those who want plain folders; grow_grid_stream doesn't.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        grid = spark.read.parquet(f"{path}/version={number - 1}")
        add_to_grid(grid, batch.select("taxon", "ord", "seq"), locus)[0].write.mode("overwrite").parquet(f"{path}/version={number}")

    writer = stream.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
