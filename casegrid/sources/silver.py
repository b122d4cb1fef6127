"""Silver: immutable snapshots, ``{root}/{table}/run_ts=.../attempt=...``, bucketed by the hash of the key.

A snapshot is a manifest that names, for every bucket, the folder that holds its rows: one the
snapshot has written, or one of an earlier snapshot. A delta therefore writes only the buckets whose
keys it brings; the files of all others are shared, and two snapshots differ at most in the buckets
that their manifests give different folders.

Folders and manifests are written once, the manifest last; without it there is no snapshot. A re-run
of the same run id makes a new attempt, so no job reads a folder it is writing; readers take the
newest attempt that has a manifest.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegrid import schemas
from casegrid.operators.dedupe import conform, latest_per_key, newest_first, union_all
from casegrid.session import scratch_path
from casegrid.sources import fs

# Buckets of a table, fixed by its first snapshot: so many that one of them is a good file of about a
# gigabyte, and few enough for a delta to leave some untouched.
BUCKETS = 16
MANIFEST = "_manifest.json"
BUCKET = "bucket"


def key_of(table: str) -> str:
    """The key is the first column of every table."""
    return schemas.SILVER[table].fieldNames()[0]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schemas.SILVER[table])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> dict:
    """``{"buckets": n, "folders": {bucket: folder}}``; buckets without rows have no folder."""
    return json.loads(fs.read_text(spark, f"{path}/{MANIFEST}"))


def snapshot_path(spark: SparkSession, root: str, table: str, run_ts: str) -> str | None:
    """Newest finished attempt of a run."""
    run_path = f"{root}/{table}/run_ts={run_ts}"
    for attempt in reversed(fs.partition_values(spark, run_path, "attempt")):
        path = f"{run_path}/attempt={attempt}"
        if fs.exists(spark, f"{path}/{MANIFEST}"):
            return path
    return None


def run_ids(spark: SparkSession, root: str, table: str) -> list[str]:
    """Run ids below the table, oldest first, finished or not. Directory names only."""
    return sorted((r for r in fs.partition_values(spark, f"{root}/{table}", "run_ts") if r.isdigit()), key=int)


def snapshot_runs(spark: SparkSession, root: str, table: str) -> list[str]:
    """Run ids with a finished snapshot, oldest first."""
    return [run for run in run_ids(spark, root, table) if snapshot_path(spark, root, table, run)]


def open_snapshot(spark: SparkSession, path: str, table: str, buckets: set[str] | None = None) -> DataFrame:
    """Rows of a snapshot; only those of the named buckets where these are given."""
    folders = manifest(spark, path)["folders"]
    chosen = [folder for bucket, folder in folders.items() if buckets is None or bucket in buckets]
    return spark.read.schema(schemas.SILVER[table]).parquet(*chosen) if chosen else empty(spark, table)


def read_snapshot(spark: SparkSession, root: str, table: str, run_ts: str) -> DataFrame | None:
    """The snapshot of exactly this run, None when there is none."""
    path = snapshot_path(spark, root, table, run_ts)
    return None if path is None else open_snapshot(spark, path, table)


def current_path(spark: SparkSession, root: str, table: str, run_ts: str | None = None) -> str | None:
    """The asked run's snapshot, else that of the latest run."""
    if run_ts is not None:
        found = snapshot_path(spark, root, table, run_ts)
        if found is not None:
            return found
    for run in reversed(run_ids(spark, root, table)):
        found = snapshot_path(spark, root, table, run)
        if found is not None:
            return found
    return None


def read_current(spark: SparkSession, root: str, table: str, run_ts: str | None = None) -> DataFrame | None:
    """The asked run, else the latest one. Always a single snapshot: reading several would repeat rows."""
    path = current_path(spark, root, table, run_ts)
    return None if path is None else open_snapshot(spark, path, table)


def read_history(spark: SparkSession, root: str, table: str, runs: list[str] | None = None) -> DataFrame:
    """Several snapshots one below the other, older files with fewer columns included."""
    runs = snapshot_runs(spark, root, table) if runs is None else runs
    paths = [path for run in runs if (path := snapshot_path(spark, root, table, run))]
    if not paths:
        return empty(spark, table)
    return union_all(*(open_snapshot(spark, path, table) for path in paths))


def _new_path(root: str, table: str, run_ts: str) -> str:
    return f"{root}/{table}/run_ts={run_ts}/attempt={time.time_ns() // 1000:020d}"


def _publish(spark: SparkSession, path: str, buckets: int, folders: dict[str, str]) -> str:
    if not fs.create_text(spark, f"{path}/{MANIFEST}", json.dumps({"buckets": buckets, "folders": folders})):
        raise FileExistsError(f"{path} has a manifest already")
    return path


def _write_buckets(rows: DataFrame, path: str) -> dict[str, str]:
    """Write rows that are dealt by ``bucket``; the folder of every bucket that has some."""
    rows.write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
    return {b: f"{path}/{BUCKET}={b}" for b in fs.partition_values(rows.sparkSession, path, BUCKET)}


def write_snapshot(df: DataFrame, root: str, table: str, run_ts: str, buckets: int = BUCKETS) -> str:
    """Write a whole snapshot from the executors, with native timestamps. Returns the new path."""
    path = _new_path(root, table, run_ts)
    rows = conform(df, schemas.SILVER[table]).withColumn(BUCKET, bucket_of(key_of(table), buckets))
    folders = _write_buckets(rows.hint("rebalance", BUCKET), path)
    return _publish(df.sparkSession, path, buckets, folders)


def merge_delta(
    spark: SparkSession, base: str | None, delta: DataFrame, root: str, table: str, run_ts: str, buckets: int = BUCKETS
) -> str:
    """The snapshot after a batch: the newest version of every key of the snapshot ``base`` or the batch.

    ``delta`` has one row per key. It is evaluated once and laid out by bucket. Only the buckets it has
    rows for are read from the base and written; each is merged and written by the task that one
    shuffle brings it to.
    """
    key = key_of(table)
    if base is None:
        return write_snapshot(delta, root, table, run_ts, buckets)
    known = manifest(spark, base)
    buckets = known["buckets"]
    staged = scratch_path(spark, f"silver-{table}")
    touched = set(_write_buckets(conform(delta, schemas.SILVER[table]).withColumn(BUCKET, bucket_of(key, buckets)), staged))
    path = _new_path(root, table, run_ts)
    if not touched:
        return _publish(spark, path, buckets, known["folders"])
    new = spark.read.schema(schemas.SILVER[table]).parquet(staged)
    both = union_all(open_snapshot(spark, base, table, touched), new).withColumn(BUCKET, bucket_of(key, buckets))
    merged = latest_per_key(both.repartition(len(touched), BUCKET), [BUCKET, key], newest_first(both.drop(BUCKET)))
    return _publish(spark, path, buckets, {**known["folders"], **_write_buckets(merged, path)})


def differing_buckets(spark: SparkSession, before: str | None, after: str | None) -> tuple[set[str], bool]:
    """Buckets that two snapshots do not share, and whether the two are laid out alike at all."""
    if before is None or after is None:
        return set(), False
    old, new = manifest(spark, before), manifest(spark, after)
    if old["buckets"] != new["buckets"]:
        return set(), False
    names = set(old["folders"]) | set(new["folders"])
    return {b for b in names if old["folders"].get(b) != new["folders"].get(b)}, True
