"""Bronze: raw resources, one partition per resource type, ingestion date and run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegrid import schemas
from casegrid.functions.dates import run_date
from casegrid.sources import fs


def bronze_rows(resources: DataFrame, run_ts: str, ingested_at: dt.datetime) -> DataFrame:
    """Envelope the columns ``resource_id, resource_type, resource_json`` of one run."""
    return resources.select(
        "resource_id",
        F.lit(ingested_at).cast("timestamp").alias("ingestion_timestamp"),
        "resource_json",
        F.coalesce("resource_type", F.lit("Unknown")).alias("resource_type"),
        run_date(F.lit(run_ts), ingested_at.date()).alias("ingestion_date"),
        F.lit(run_ts).alias("run_ts"),
    )


def write_bronze(rows: DataFrame, root: str, replace: bool = False) -> None:
    """Append a run, or replace the partitions it touches.

    A resource type with very many rows is spread over several tasks and files.
    """
    (
        rows.hint("rebalance", *schemas.BRONZE_PARTITIONS)
        .write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*schemas.BRONZE_PARTITIONS)
        .option("compression", "snappy")
        .parquet(root)
    )


def run_order(run: str) -> tuple[bool, int, str]:
    """All-digit run ids by number, after all others by name."""
    return run.isdigit(), int(run) if run.isdigit() else 0, run


def landed_runs(spark: SparkSession, root: str, resource_type: str) -> list[str]:
    """Run ids of a type, oldest first, from directory names of all dates."""
    kind = f"{root}/resource_type={resource_type}"
    found = {
        run
        for day in fs.partition_values(spark, kind, "ingestion_date")
        for run in fs.partition_values(spark, f"{kind}/ingestion_date={day}", "run_ts")
    }
    return sorted(found, key=run_order)


def run_marks(spark: SparkSession, root: str, resource_type: str) -> dict[str, dt.datetime]:
    """When the newest file of every run of a type was written, from directory listings alone; oldest run first."""
    kind = f"{root}/resource_type={resource_type}"
    found: dict[str, int] = {}
    for day in fs.partition_values(spark, kind, "ingestion_date"):
        for run in fs.partition_values(spark, f"{kind}/ingestion_date={day}", "run_ts"):
            newest = fs.newest_file_time(spark, f"{kind}/ingestion_date={day}/run_ts={run}")
            found[run] = max(newest, found.get(run, 0))
    epoch = dt.datetime(1970, 1, 1)
    return {run: epoch + dt.timedelta(milliseconds=found[run]) for run in sorted(found, key=run_order)}


def written_after(mark: dt.datetime) -> Column:
    """Rows of files written after the mark; files before it are not opened."""
    return F.col("_metadata.file_modification_time") > F.lit(mark).cast("timestamp")


def latest_run(spark: SparkSession, root: str) -> str | None:
    """Largest all-digit run id of any type and date."""
    kinds = fs.partition_values(spark, root, "resource_type")
    runs = {run for kind in kinds for run in landed_runs(spark, root, kind) if run.isdigit()}
    return max(runs, key=int, default=None)


def newer_than(stamp: Column, cursor: dt.datetime | None) -> Column:
    """Strictly newer than the cursor; no cursor keeps everything."""
    return F.lit(True) if cursor is None else stamp > F.lit(cursor).cast("timestamp")


def read_bronze(
    spark: SparkSession,
    root: str,
    resource_type: str | None = None,
    run_ts: str | None = None,
    since: dt.datetime | None = None,
    date: str | None = None,
) -> DataFrame:
    """Rows of the asked type, run and date, newer than the cursor.

    Type, run and date prune partitions; the cursor reaches the Parquet statistics. A run that has no
    rows of the type gives an empty table.
    """
    if not fs.exists(spark, root):
        return spark.createDataFrame([], schemas.BRONZE)
    rows = spark.read.schema(schemas.BRONZE).parquet(root)
    for column, value in (("resource_type", resource_type), ("run_ts", run_ts), ("ingestion_date", date)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows if since is None else rows.where(newer_than(F.col("ingestion_timestamp"), since))
