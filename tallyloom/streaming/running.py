"""Running counts of reads that arrive in files, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyloom.session import shared_folder


def read_stream(spark: SparkSession, path: str, schema: str, *, files_a_batch: int = 100) -> DataFrame:
    """A stream over a Parquet file or the files of a folder, ``files_a_batch`` in each micro-batch.

    The path is given as a pattern that matches itself only: a stream takes a plain path for a folder.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, *, mode: str = "update") -> StreamingQuery:
    """Handle all that has arrived, batch by batch, with ``write``; what is done is kept in the shared folder under ``name``."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).trigger(availableNow=True)
        .option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/{name}/progress").start()
    )
    query.awaitTermination()
    return query


def running_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key so far."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def molecules(stream: DataFrame, keys: list[str], umi: str, *, time: str, lateness: str) -> DataFrame:
    """The first read of each (keys, UMI); a repetition is dropped if it comes within ``lateness``, which bounds the state."""
    known = stream.where(F.col(umi).isNotNull())
    return known.withWatermark(time, lateness).dropDuplicatesWithinWatermark([*keys, umi])


class Progress(StreamingQueryListener):
    """Keeps the number of rows handled so far."""

    def __init__(self) -> None:
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
