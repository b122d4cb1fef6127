"""Incremental Bronze -> Silver step."""

from __future__ import annotations

import datetime as dt
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid import schemas
from casegrid.operators.dedupe import conform, latest_per_key, split_rejects
from casegrid.plans.layout import Layout
from casegrid.sources import bronze, fhir, silver, state

STATE_ID = "silver_latest_run"


@dataclass(frozen=True)
class StepResult:
    run_ts: str
    records: int
    tables: dict[str, str]
    carried_forward: list[str]


def silver_table(spark: SparkSession, layout: Layout, table: str, run_ts: str | None = None) -> DataFrame | None:
    """Published table: by the pointer in the run state, else by the newest finished snapshot."""
    pointer = state.get_run_state(spark, layout.state, STATE_ID)
    if pointer and run_ts in (None, pointer["run_ts"]) and table in pointer.get("tables", {}):
        return silver.open_snapshot(spark, pointer["tables"][table], table)
    return silver.read_current(spark, layout.silver, table, run_ts)


def extract(delta: DataFrame, resource_type: str, run_time: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(one row per key of the batch, rows without a key)."""
    table, key, project = fhir.RESOURCES[resource_type]
    rows = conform(project(delta, run_time), schemas.SILVER[table])
    usable, rejects = split_rejects(rows, key)
    return latest_per_key(usable, key), rejects


def unmerged(
    spark: SparkSession,
    layout: Layout,
    resource_type: str,
    cursors: dict[str, dt.datetime],
    marks: dict[str, dt.datetime],
    run: str | None,
) -> tuple[DataFrame, dict[str, dt.datetime]]:
    """Rows of a type that no step has merged, and the runs they are in with the marks of their files.

    A named run is read whole, whatever was merged before. Otherwise these are all runs without a
    cursor, and of every merged run, however old, the files written since it was merged: rows that
    came late, or a run that was landed again. Which runs have such files is seen from directory
    listings; the other files are not opened.
    """
    landed = bronze.run_marks(spark, layout.bronze, resource_type)
    if run is not None:
        return bronze.read_bronze(spark, layout.bronze, resource_type, run), {run: landed[run]} if run in landed else {}
    rows = bronze.read_bronze(spark, layout.bronze, resource_type)
    fresh = [r for r in landed if r not in cursors]
    late = [r for r in landed if r in cursors and landed[r] > marks.get(r, dt.datetime.min)]
    if not fresh and not late:
        return rows.limit(0), {}
    wanted = F.col("run_ts").isin(fresh)
    for r in late:
        since = bronze.written_after(marks[r]) if r in marks else bronze.newer_than(F.col("ingestion_timestamp"), cursors[r])
        wanted = wanted | ((F.col("run_ts") == r) & since)
    return rows.where(F.col("run_ts").isin(fresh + late)).where(wanted), {r: landed[r] for r in fresh + late}


def bronze_to_silver(
    spark: SparkSession,
    layout: Layout,
    run_time: dt.datetime,
    bronze_ts: str | None = None,
    silver_ts: str | None = None,
    pipeline_run_id: str | None = None,
) -> StepResult:
    """Merge what has landed in Bronze into the five Silver tables and publish the result.

    Without ``bronze_ts`` every run that a table has not merged is read, so that landings which meet
    one step are not lost; with it that run is read whole. Each table keeps a cursor per run, moved
    only over runs that were read and in the commit that publishes the new state: a failure before it
    leads to a repeated merge, not to a gap, and of two steps at once one is refused. A table without new rows is carried forward by pointing
    at its present snapshot; of the others only the buckets that get rows are written. Rejects are
    written below a name that a repeated step writes again.
    """
    try:
        return _step(spark, layout, run_time, bronze_ts, silver_ts, pipeline_run_id)
    except Exception as error:
        state.record_job(
            spark, layout.state, "bronze_to_silver", "failed", 0, run_time, error=str(error)[:1000], pipeline_run_id=pipeline_run_id
        )
        raise


def _step(spark, layout, run_time, bronze_ts, silver_ts, pipeline_run_id) -> StepResult:
    base_state = state.snapshot(spark, layout.state)
    pointer = state.run_state(base_state, STATE_ID) or {}
    published: dict[str, str] = dict(pointer.get("tables", {}))
    names = [table for table, _, _ in fhir.RESOURCES.values()]
    cursors, marks = (state.run_cursors(base_state, names, sign) for sign in "@#")
    pending = {
        kind: unmerged(spark, layout, kind, cursors.get(table, {}), marks.get(table, {}), bronze_ts)
        for kind, (table, _, _) in fhir.RESOURCES.items()
    }
    runs = sorted({run for _, found in pending.values() for run in found}, key=bronze.run_order)
    source = bronze_ts or (runs[-1] if runs else pointer.get("bronze_ts"))
    if source is None:
        raise FileNotFoundError(f"no Bronze run below {layout.bronze}")
    target = silver_ts or source
    before = [sorted((table, sorted(stamps.items())) for table, stamps in values.items()) for values in (cursors, marks)]
    attempt = f"{target}-{zlib.crc32(repr(before).encode()):08x}"
    records, carried, moved, seen, metrics = 0, [], {}, {}, []
    for resource_type, (table, _, _) in fhir.RESOURCES.items():
        delta, seen[table] = pending[resource_type]
        if not seen[table]:
            carried.append(table)
            continue
        # One pass over two narrow columns answers "anything new?", the counts and the cursors.
        arrived = {
            r["run_ts"]: (r["rows"], r["newest"])
            for r in delta.groupBy("run_ts").agg(F.count("*").alias("rows"), F.max("ingestion_timestamp").alias("newest")).collect()
        }
        if not arrived:
            carried.append(table)
            continue
        base = published.get(table) or silver.current_path(spark, layout.silver, table, target)
        fresh, rejects = extract(delta, resource_type, run_time)
        published[table] = silver.merge_delta(spark, base, fresh, layout.silver, table, target)
        refused = f"{layout.rejects}/{table}/batch={attempt}"
        rejects.write.mode("overwrite").parquet(refused)
        rows = sum(n for n, _ in arrived.values())
        metrics += [(table, "rows", rows), (table, "rejects", spark.read.parquet(refused).count())]
        moved[table] = {run: max(newest, cursors.get(table, {}).get(run, newest)) for run, (_, newest) in arrived.items()}
        records += rows
    # The new state and the cursors up to it are one commit, refused if another step has published since.
    pointed = state.run_state_change(
        STATE_ID, target, run_time, bronze_ts=source, pipeline_run_id=pipeline_run_id, tables=published
    )
    changes = {**pointed, **state.run_cursor_changes(moved), **state.run_cursor_changes(seen, "#")}
    state.publish(spark, layout.state, base_state, changes, (state.state_name(STATE_ID),))
    state.record_quality(spark, layout.state, metrics, run_time)
    state.record_job(
        spark, layout.state, "bronze_to_silver", "completed", records, run_time,
        pipeline_run_id=pipeline_run_id, details={"bronze_ts": source, "silver_ts": target, "runs": runs},
    )
    return StepResult(target, records, published, carried)
