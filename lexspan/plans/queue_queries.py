"""The job queue and registry rules over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators import jobs
from lexspan.plans._tables import table

_STATES = ["queued", "running", "completed", "failed"]
_NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), status.alias("status"), F.col("event_type").alias("job_type"), F.concat(F.lit("./in//u"), F.col("user_id")).alias("file_path"), F.date_trunc("second", F.col("ts")).alias("created_at"), F.when(status.isin("completed", "failed"), F.date_trunc("second", F.col("ts"))).alias("completed_at"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("string").alias("error_message"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.lit(1).alias("max_retries"))


_JOBS_SQL = f"jobs AS (SELECT event_id AS id, {_STATES}[event_id % 4 + 1] AS status, event_type AS job_type, user_id, date_trunc('second', ts) AS created_at, event_id % 3 AS retry_count FROM events)"


def queue_stats_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_stats(_jobs(spark, sf_dir))


def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("phase"), (F.col("event_id") % 10).alias("items_done"), F.lit(10).alias("total_items"), F.date_trunc("minute", F.col("ts")).alias("timestamp"))
    return jobs.latest_progress(p).select("job_id", "phase", "items_done")


def recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(_jobs(spark, sf_dir), 50, 50).select("id", "status")


def stale_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs are cancelled, and old settled ones go; counted by state and message."""
    now = F.expr(_NOW)
    left = jobs.without_old(jobs.stale_cancelled(_jobs(spark, sf_dir), now), now, 730)
    return left.groupBy("status", F.col("error_message").isNotNull().alias("has_message")).agg(F.count("*").alias("n_jobs"), F.max("id").alias("max_id"))


def fail_or_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All running jobs fail: those with tries left are queued again."""
    j = _jobs(spark, sf_dir)
    ids = j.where("status = 'running'").select("id", F.lit("boom").alias("error_message"))
    return jobs.failed(j, ids, F.expr(_NOW)).groupBy("status", "retry_count", "error_message").agg(F.count("*").alias("n_jobs"))


def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.claim(_jobs(spark, sf_dir), "w1", F.expr(_NOW)).where("worker_id IS NOT NULL").select("id", "status", "worker_id")


def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").select(F.concat(F.lit("in\\u"), F.col("user_id")).alias("file_path"), F.col("event_type").alias("job_type")).distinct()
    return jobs.active(_jobs(spark, sf_dir), wanted).groupBy("job_type").agg(F.count("*").alias("n_active"))


def org_rollup_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is ready if all its customers have a balance, a region if its nations are."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nation = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_regionkey").agg(F.coalesce(F.bool_and(F.col("c_acctbal") > -900), F.lit(True)).alias("ready"), F.count("c_custkey").alias("n_items"))
    region = r.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey").agg(F.coalesce(F.bool_and("ready"), F.lit(True)).alias("ready"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"))
    return nation.select(F.lit("nation").alias("level"), F.col("n_nationkey").alias("ident"), "ready", "n_items").unionByName(region.select(F.lit("region").alias("level"), F.col("r_regionkey").alias("ident"), "ready", "n_items"))


QUERIES = {
    "queue_stats_zero_filled": queue_stats_zero_filled, "latest_progress": latest_progress, "recent_page": recent_page, "stale_cleanup": stale_cleanup, "fail_or_requeue": fail_or_requeue, "claim_next": claim_next,
    "active_jobs": active_jobs, "org_rollup_readiness": org_rollup_readiness,
}
ORACLES = {
    "queue_stats_zero_filled": f"WITH {_JOBS_SQL} SELECT s.status, count(id) AS n_jobs FROM (SELECT unnest({jobs.STATES}) AS status) s LEFT JOIN jobs USING (status) GROUP BY s.status",
    "latest_progress": "SELECT job_id, phase, items_done FROM (SELECT user_id AS job_id, event_type AS phase, event_id % 10 AS items_done, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('minute', ts) DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "recent_page": f"WITH {_JOBS_SQL} SELECT id, status FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50",
    "stale_cleanup": f"WITH {_JOBS_SQL} SELECT CASE status WHEN 'running' THEN 'cancelled' ELSE status END AS status, status = 'running' AS has_message, count(*) AS n_jobs, max(id) AS max_id FROM jobs WHERE NOT (status IN ('completed', 'failed') AND created_at < {_NOW} - INTERVAL 730 DAY) GROUP BY 1, 2",
    "fail_or_requeue": f"WITH {_JOBS_SQL} SELECT CASE WHEN status = 'running' THEN CASE WHEN retry_count < 1 THEN 'queued' ELSE 'failed' END ELSE status END AS status, (retry_count + CASE WHEN status = 'running' AND retry_count < 1 THEN 1 ELSE 0 END)::INT AS retry_count, CASE WHEN status = 'running' THEN 'boom' END AS error_message, count(*) AS n_jobs FROM jobs GROUP BY 1, 2, 3",
    "claim_next": f"WITH {_JOBS_SQL} SELECT id, 'running' AS status, 'w1' AS worker_id FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1",
    "active_jobs": f"WITH {_JOBS_SQL} SELECT job_type, count(DISTINCT user_id) AS n_active FROM jobs WHERE status IN ('queued', 'running') GROUP BY job_type",
    "org_rollup_readiness": "WITH n AS (SELECT n_nationkey, n_regionkey, coalesce(bool_and(c_acctbal > -900), true) AS ready, count(c_custkey) AS n_items FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT 'nation' AS level, n_nationkey AS ident, ready, n_items FROM n UNION ALL SELECT 'region', r_regionkey, coalesce(bool_and(ready), true), coalesce(sum(n_items), 0)::BIGINT FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY 2",
}
