"""The queue's polling loops as Structured Streaming.

The event log of jobs is the stream; nothing here polls.  The windowed count at
the end goes beyond what the polled queue offers and is labelled an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "job_id long, status string, job_type string, ts timestamp"


def read(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_worker(events: DataFrame, handlers: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> StreamingQuery:
    """Gives each trigger's queued jobs, oldest first, to the handler of their type."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for kind, handle in handlers.items():
            handle(batch.where((F.col("status") == "queued") & (F.col("job_type") == kind)).orderBy("ts", "job_id"))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(progress: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Progress rows (job_id, items_done, ts, ...) that say something new; states over the delay old are forgotten."""
    return progress.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "items_done"])


def counts_by_window(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Extension: events by state and window of event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))


def flush(rows: DataFrame, path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Appends to Parquet, by time if seconds are given, else all that is there."""
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()
