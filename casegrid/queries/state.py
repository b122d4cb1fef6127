"""Run-state logs: appended to files, read back as current values."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.functions.dates import iso_utc
from casegrid.queries import data
from casegrid.queries.data import table
from casegrid.queries.registry import query
from casegrid.session import scratch_path
from casegrid.sources import state



def _logged(spark, log, *batches):
    root = scratch_path(spark, "state")
    for batch in batches:
        state.append(batch, root, log)
    return state.read_log(spark, root, log)


def _halves(rows):
    return rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")


@query("cursor_state", sql="""
    SELECT 'cursor-' || CAST(user_id AS VARCHAR) AS id, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_cursor FROM events GROUP BY user_id""")
def cursor_state(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("cursor-"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").alias("last_cursor"), F.col("ts").alias("last_update"),
    )
    current = state.current(_logged(spark, "cursors", *_halves(rows)))
    return current.select("id", iso_utc(F.col("last_cursor")).alias("last_cursor"))


@query("run_state", sql="""
    SELECT event_type || '_latest_run' AS id, CAST(arg_max(event_id, ts) AS VARCHAR) AS run_ts,
           arg_max(user_id, ts) AS user_id FROM events GROUP BY event_type""")
def run_state(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.concat("event_type", F.lit("_latest_run")).alias("id"), F.col("event_id").cast("string").alias("run_ts"),
        F.to_json(F.struct("user_id")).alias("details"), F.col("ts").alias("last_update"),
    )
    current = state.current(_logged(spark, "run_state", *_halves(rows)))
    return current.select("id", "run_ts", F.from_json("details", "user_id bigint")["user_id"].alias("user_id"))


@query("run_summary", sql="""
    SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, ts) AS status, arg_max(CAST(event_id AS VARCHAR), ts) FILTER (event_type = 'error') AS error,
           strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_update
    FROM events GROUP BY user_id""")
def run_summary(spark, sf):
    """Partial updates per run: the newest non-null value of every field, created_at from the first one."""
    rows = table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"),
        F.when(F.col("event_type") == "error", F.col("event_id").cast("string")).alias("error"), F.col("ts").alias("last_update"),
    )
    current = state.current_runs(_logged(spark, "runs", *_halves(rows)))
    return current.select(
        "id", "status", "error", iso_utc(F.col("created_at")).alias("created_at"), iso_utc(F.col("last_update")).alias("last_update")
    )


def _jobs(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("user_id").alias("records_processed"), F.col("ts").alias("started_at"), F.col("ts").alias("created_at"),
    )


@query("job_log", sql="""
    SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, count(*) AS jobs, CAST(sum(user_id) AS BIGINT) AS records
    FROM events GROUP BY ALL""")
def job_log(spark, sf):
    log = _logged(spark, "jobs", *_halves(_jobs(spark, sf)))
    return log.groupBy("status").agg(F.count("*").alias("jobs"), F.sum("records_processed").alias("records"))


@query("latest_jobs", sql="""
    SELECT 'job-' || CAST(event_id AS VARCHAR) AS job_name, user_id AS records_processed FROM events ORDER BY ts DESC, event_id LIMIT 10""")
def latest_jobs(spark, sf):
    return state.latest_jobs(_jobs(spark, sf)).select("job_name", "records_processed")


@query("dq_log", sql="""
    SELECT event_type AS table_name, metric, value FROM (
        SELECT event_type, CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM events GROUP BY event_type)
    UNPIVOT (value FOR metric IN (rows, users))""")
def dq_log(spark, sf):
    per_type = table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").cast("double").alias("rows"), F.count_distinct("user_id").cast("double").alias("users")
    )
    rows = per_type.withColumnRenamed("event_type", "table_name").withColumn("run_date", F.lit(data.RUN_TIME).cast("timestamp"))
    long = rows.unpivot(["table_name", "run_date"], ["rows", "users"], "metric", "value")
    return _logged(spark, "quality", long).select("table_name", "metric", "value")
