"""Run state: named cursors and pointers in a log of commits, and append-only Parquet logs of jobs, runs and quality.

In the Parquet logs the newest row per id is the current value.
"""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from casegrid import schemas
from casegrid.operators.dedupe import conform, latest_per_key
from casegrid.operators.ranking import largest
from casegrid.sources import commits, fs

LOGS = {
    "cursors": schemas.CURSOR_LOG,
    "run_state": schemas.RUN_STATE_LOG,
    "jobs": schemas.JOB_LOG,
    "runs": schemas.RUN_SUMMARY_LOG,
    "quality": schemas.QUALITY_LOG,
}


def append(df: DataFrame, root: str, log: str) -> None:
    conform(df, LOGS[log]).write.mode("append").parquet(f"{root}/{log}")


def append_values(spark: SparkSession, root: str, log: str, **values: Any) -> None:
    schema: T.StructType = LOGS[log]
    append(spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema), root, log)


def read_log(spark: SparkSession, root: str, log: str) -> DataFrame:
    path = f"{root}/{log}"
    if not fs.exists(spark, path):
        return spark.createDataFrame([], LOGS[log])
    return spark.read.schema(LOGS[log]).parquet(path)


def current(log: DataFrame, key: str = "id", stamp: str = "last_update") -> DataFrame:
    """Newest row per id."""
    content = F.xxhash64(*[c for c in log.columns if c != stamp])
    return latest_per_key(log, key, [F.col(stamp).desc_nulls_last(), content.desc()])


def current_runs(log: DataFrame) -> DataFrame:
    """Newest non-null value of every field per run; ``created_at`` is the first time it was seen."""
    fields = [c for c in log.columns if c not in ("id", "last_update")]
    newest = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_update"))).alias(c) for c in fields
    ]
    return log.groupBy("id").agg(
        *newest, F.min("last_update").alias("created_at"), F.max("last_update").alias("last_update")
    )


# --- named cursors and run states, in one log of commits: what a job publishes is one commit


def snapshot(spark: SparkSession, root: str) -> commits.State:
    """All named values as of the newest commit."""
    return commits.read(spark, f"{root}/commits")


def publish(spark: SparkSession, root: str, base: commits.State, changes: dict[str, Any], guard: tuple[str, ...] = ()) -> commits.State:
    """Change named values at once; refused if a guarded one has changed since ``base`` was read."""
    return commits.publish(spark, f"{root}/commits", base, changes, guard)


def state_name(state_id: str) -> str:
    return f"state:{state_id}"


def run_state_change(state_id: str, run_ts: str, at: dt.datetime, **details: Any) -> dict[str, Any]:
    value = {**json.loads(json.dumps(details, default=str)), "run_ts": run_ts, "last_update": at.isoformat()}
    return {state_name(state_id): value}


def run_state(base: commits.State, state_id: str) -> dict[str, Any] | None:
    found = base.values.get(state_name(state_id))
    return None if found is None else {k: v for k, v in found.items() if k != "last_update"}


def cursor_changes(cursors: dict[str, dt.datetime]) -> dict[str, str]:
    return {f"cursor:{name}": stamp.isoformat() for name, stamp in cursors.items()}


def run_cursor_changes(table_cursors: dict[str, dict[str, dt.datetime]], sign: str = "@") -> dict[str, str]:
    """Cursors of runs by table; with ``#`` the marks of the files that were read."""
    return cursor_changes({f"{table}{sign}{run}": stamp for table, runs in table_cursors.items() for run, stamp in runs.items()})


def run_cursors(base: commits.State, tables: list[str], sign: str = "@") -> dict[str, dict[str, dt.datetime]]:
    """Cursor of every run that a table has merged; with ``#`` the marks of the files read."""
    out: dict[str, dict[str, dt.datetime]] = {}
    for name, value in base.values.items():
        table, found, run = name.removeprefix("cursor:").partition(sign)
        if name.startswith("cursor:") and found and table in tables:
            out.setdefault(table, {})[run] = dt.datetime.fromisoformat(value)
    return out


def set_cursors(spark: SparkSession, root: str, cursors: dict[str, dt.datetime]) -> None:
    """Move named cursors. Call it after the data up to them is published."""
    if cursors:
        publish(spark, root, commits.State(), cursor_changes(cursors))


def get_cursors(spark: SparkSession, root: str, names: list[str]) -> dict[str, dt.datetime]:
    """Current value of each named cursor that was ever set."""
    values = snapshot(spark, root).values
    return {n: dt.datetime.fromisoformat(values[f"cursor:{n}"]) for n in names if f"cursor:{n}" in values}


def get_run_cursors(spark: SparkSession, root: str, tables: list[str]) -> dict[str, dict[str, dt.datetime]]:
    return run_cursors(snapshot(spark, root), tables)


def set_run_state(spark: SparkSession, root: str, state_id: str, run_ts: str, at: dt.datetime, **details: Any) -> None:
    """Set one run state, whatever it was."""
    publish(spark, root, commits.State(), run_state_change(state_id, run_ts, at, **details))


def get_run_state(spark: SparkSession, root: str, state_id: str) -> dict[str, Any] | None:
    return run_state(snapshot(spark, root), state_id)


def record_quality(
    spark: SparkSession, root: str, metrics: list[tuple[str, str, int]], at: dt.datetime
) -> None:
    """One row per (table, metric, value) of a job."""
    if metrics:
        rows = [(table, at, metric, float(value)) for table, metric, value in metrics]
        append(spark.createDataFrame(rows, schemas.QUALITY_LOG), root, "quality")


def record_job(
    spark: SparkSession, root: str, job_name: str, status: str, records: int, at: dt.datetime,
    error: str | None = None, pipeline_run_id: str | None = None, details: dict | None = None,
) -> None:
    append_values(
        spark, root, "jobs", job_name=job_name, status=status, records_processed=records, started_at=at,
        created_at=at, error_message=error, pipeline_run_id=pipeline_run_id,
        details=json.dumps(details, default=str) if details else None,
    )


def record_run(spark: SparkSession, root: str, run_id: str, at: dt.datetime, **values: Any) -> None:
    append_values(spark, root, "runs", id=run_id, last_update=at, **values)


def latest_jobs(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest job records first."""
    return largest(jobs, [F.col("created_at").desc(), F.col("job_name")], limit)
