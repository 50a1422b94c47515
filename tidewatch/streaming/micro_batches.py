"""Structured Streaming around the batch checks.

Uplinks arrive as a stream and are appended to the event store; after each micro-batch the same
batch pass runs over the store. Absence needs a clock, not an event, so the pass stays a full
recomputation of its lookback window, and late rows count as long as their time lies in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import SCHEMAS


def uplinks(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of uplink files."""
    return spark.readStream.schema(SCHEMAS["event_up"]).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_then(stream: DataFrame, store: str, checkpoint: str, after: Callable[[SparkSession, int], None]) -> StreamingQuery:
    """Append each micro-batch to the store, one folder a batch (a batch that is tried again replaces its own), then call after."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        after(batch.sparkSession, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Append-only roll-up: uplinks of each device by hour, closed when the watermark has passed."""
    return (
        stream.withWatermark("time", late)
        .groupBy(F.window("time", "1 hour").alias("hour"), "dev_eui")
        .agg(F.count("*").alias("uplinks"), F.max("time").alias("last_seen"))
        .select("dev_eui", F.col("hour.start").alias("hour"), "uplinks", "last_seen")
    )
