"""The job queue as tables: jobs, job_progress, job_logs.

Transitions are rewrites of the table that they are given; who stores the
result decides on atomicity, which plain Parquet doesn't give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ["queued", "running", "completed", "failed", "cancelled"]
RESTARTED = "cancelled: it was running when the worker restarted"


def queue_stats(jobs: DataFrame, states: list[str] = STATES) -> DataFrame:
    """Jobs by state, zero for states without any."""
    domain = jobs.sparkSession.createDataFrame([(s,) for s in states], "status string")
    return F.broadcast(domain).join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_jobs"))


def enqueue(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """jobs with new(job_type, file_path, max_retries) queued under the next ids,
    in the order of path and type; what has a queued or running job already,
    or comes twice, isn't queued again."""
    free = new.join(active(jobs, new.select("file_path", "job_type")), ["file_path", "job_type"], "left_anti")
    free = free.withColumn("_p", plain_path(F.col("file_path")))
    free = free.withColumn("_n", F.row_number().over(Window.partitionBy("_p", "job_type").orderBy("file_path"))).where("_n = 1")
    last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    number = F.col("_last") + F.row_number().over(Window.orderBy("_p", "job_type"))
    rows = free.crossJoin(F.broadcast(last)).withColumns({"id": number, "status": F.lit("queued"), "created_at": now, "retry_count": F.lit(0)})
    none = {c: F.lit(None).cast(t) for c, t in jobs.dtypes if c not in rows.columns}
    rows = rows.withColumns(none)
    return jobs.unionByName(rows.select(*[F.col(c).cast(t).alias(c) for c, t in jobs.dtypes]))


def progress_updated(progress: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """progress with a row for each new(job_id, phase, items_done, total_items), under the next ids."""
    last = progress.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    rows = new.crossJoin(F.broadcast(last)).withColumns({"id": F.col("_last") + F.row_number().over(Window.orderBy("job_id", "phase", "items_done")), "timestamp": now})
    return progress.unionByName(rows.select(*[F.col(c).cast(t).alias(c) for c, t in progress.dtypes]))


def latest_progress(progress: DataFrame) -> DataFrame:
    """The last progress row of each job; later ids win within one second."""
    last = F.max_by(F.struct("phase", "items_done", "total_items", "timestamp"), F.struct("timestamp", "id"))
    return progress.groupBy("job_id").agg(last.alias("p")).select("job_id", "p.*")


def job_status(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    return jobs.join(latest_progress(progress).withColumnRenamed("job_id", "id"), "id", "left")


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job; the least id of equally old ones."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def claim(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """jobs after the next one was set to running."""
    chosen = next_job(jobs).select("id", F.lit(True).alias("_mine"))
    rows = jobs.join(F.broadcast(chosen), "id", "left")
    mine = F.coalesce("_mine", F.lit(False))
    return rows.withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "started_at": F.when(mine, now).otherwise(F.col("started_at")), "worker_id": F.when(mine, worker).otherwise(F.col("worker_id"))}).drop("_mine")


def completed(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _changed(jobs, ids, {"status": F.lit("completed"), "completed_at": now})


def failed(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Jobs with tries left are queued again, the others have failed.  ids: id, error_message."""
    again = F.coalesce("retry_count", F.lit(0)) < F.coalesce("max_retries", F.lit(0))
    nothing = lambda c: F.when(~again, F.col(c))
    return _changed(jobs, ids.withColumnRenamed("error_message", "_error"), {"status": F.when(again, "queued").otherwise("failed"), "completed_at": F.when(again, F.col("completed_at")).otherwise(now), "started_at": nothing("started_at"), "worker_id": nothing("worker_id"), "error_message": F.col("_error"), "retry_count": F.col("retry_count") + again.cast("int")}, ["_error"])


def cancelled(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Queued and running jobs among ids are cancelled."""
    return _changed(jobs, jobs.where("status IN ('queued', 'running')").join(ids.select("id"), "id", "left_semi").select("id"), {"status": F.lit("cancelled"), "completed_at": now})


def stale_cancelled(jobs: DataFrame, now: Column) -> DataFrame:
    """What runs when a worker starts can't be running."""
    stale = F.col("status") == "running"
    return jobs.withColumns({"completed_at": F.when(stale, now).otherwise(F.col("completed_at")), "error_message": F.when(stale, RESTARTED).otherwise(F.col("error_message")), "status": F.when(stale, "cancelled").otherwise(F.col("status"))})


def _changed(jobs: DataFrame, ids: DataFrame, new: dict[str, Column], extra: list[str] | None = None) -> DataFrame:
    rows = jobs.join(ids.select("id", F.lit(True).alias("_hit"), *(extra or [])), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).select(jobs.columns)


def without_old(jobs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Without completed and failed jobs over `days` old; cancelled ones stay."""
    old = F.col("status").isin("completed", "failed") & (F.col("completed_at") < now - F.make_dt_interval(F.lit(days)))
    return jobs.where(~F.coalesce(old, F.lit(False)))


def without_orphans(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Progress or log rows whose job still is there."""
    return rows.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def recent(jobs: DataFrame, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
    """A page of the newest jobs; the greater id first in one second."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def page_count(n: Column, size: int = 50) -> Column:
    return F.ceil(n / size)


def plain_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./|/(?=/)", "")


def active(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted(file_path, job_type) those with a queued or running job; paths
    are compared with forward slashes and without a ./ in front."""
    there = jobs.where("status IN ('queued', 'running')").select(plain_path(F.col("file_path")).alias("_p"), "job_type")
    return wanted.withColumn("_p", plain_path(F.col("file_path"))).join(there, ["_p", "job_type"], "left_semi").drop("_p")
