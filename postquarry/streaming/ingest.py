"""Incremental forms: new rows once, snapshots reconciled, both restartable from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..sources import sinks


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything that has arrived, batch by batch, then stop; a restart goes on where the last run ended."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_rows(stream: DataFrame, key: str, when: str, lateness: str) -> DataFrame:
    """Each key once; its state is kept for ``lateness`` after the newest ``when``, so it doesn't grow for ever."""
    return stream.withWatermark(when, lateness).dropDuplicatesWithinWatermark([key])


def look_back(last_run: str | None, today: date, most_days: int, first_days: int = 1) -> date:
    """The day from which rows are asked for: the day of the last run, a day back on the first one, never more than ``most_days``."""
    since = date.fromisoformat(last_run) if last_run else today - timedelta(days=first_days)
    return max(since, today - timedelta(days=most_days))


def due(last_run: str | None, today: date) -> bool:
    """Whether a run is due: at most one a day."""
    return last_run != today.isoformat()


def windowed_counts(stream: DataFrame, when: str, width: str, lateness: str, *keys: str) -> DataFrame:
    """Rows per time window and keys; rows later than ``lateness`` are left out."""
    return stream.withWatermark(when, lateness).groupBy(F.window(when, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def upserting(path: str, key: str, *order) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch over a table by key. Run again, it gives the same table."""

    def each(batch: DataFrame, number: int) -> None:
        sinks.upsert_table(batch, path, key, *order)

    return each


def reconciling(path: str, key: str, *order) -> Callable[[DataFrame, int], None]:
    """A batch function for full snapshots: rows are upserted, and what the snapshot lacks becomes inactive.

    An empty snapshot (nothing was seen at all) changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        old = sinks.read_table(batch.sparkSession, path, batch.schema.simpleString()[7:-1])
        merged = tables.upsert(old, batch, key, *order)
        sinks.overwrite(tables.reconcile_active(merged, batch, key), path, key)

    return each
