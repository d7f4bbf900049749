"""The queue's streams, run over all that is there, and what they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.state import use_shared_folder
from lexspan.streaming import job_events


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = job_events.read(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern may name a file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _all_of(rows: DataFrame) -> DataFrame:
    """Runs a stream until nothing is left and reads its output."""
    spark = rows.sparkSession
    use_shared_folder(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/stream-{uuid.uuid4().hex}"
    job_events.flush(rows, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of users that says something new, each state once."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("items_done"), "ts")
    return _all_of(job_events.changes(e)).select("job_id", "items_done")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and hour, of the hours that are over for good when all is read."""
    e = _events(spark, sf_dir).select("ts", F.col("event_type").alias("status"))
    return _all_of(job_events.counts_by_window(e)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "status", "n")


def stream_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued jobs that a worker handed to the handler of their type."""
    use_shared_folder(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/worker-{uuid.uuid4().hex}"
    status = F.when(F.col("event_id") % 2 == 0, "queued").otherwise("running")
    e = _events(spark, sf_dir).select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("event_type").alias("job_type"), "ts")
    handle = lambda rows: rows.select("job_id", "job_type").write.mode("append").parquet(f"{base}/out")
    job_events.run_worker(e, {"purchase": handle, "view": handle}, f"{base}/state").awaitTermination()
    return spark.read.schema("job_id long, job_type string").parquet(f"{base}/out")


QUERIES = {"stream_changes": stream_changes, "stream_windows": stream_windows, "stream_worker": stream_worker}
ORACLES = {
    "stream_changes": "SELECT DISTINCT user_id AS job_id, event_id % 3 AS items_done FROM events",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS status, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2",
    "stream_worker": "SELECT event_id AS job_id, event_type AS job_type FROM events WHERE event_id % 2 = 0 AND event_type IN ('purchase', 'view')",
}
