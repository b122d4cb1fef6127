"""Landed searchset pages -> Bronze."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import SparkSession, functions as F

from casegrid.functions.dates import parse_timestamp
from casegrid.plans.layout import Layout
from casegrid.sources import bronze, fhir, state

STATE_ID = "bronze_latest_run"
CURSOR = "pages_to_bronze:{kind}"


@dataclass(frozen=True)
class Landing:
    run_ts: str
    records: int
    cursors: dict[str, dt.datetime]


def pages_to_bronze(
    spark: SparkSession, layout: Layout, pages: str, run_ts: str, run_time: dt.datetime, pipeline_run_id: str | None = None
) -> Landing:
    """Write the resources of all page files below ``pages`` as one Bronze run.

    A run that is landed again replaces what it wrote before. The cursor of a resource type is its
    newest ``meta.lastUpdated`` and never moves back. Cursors, run state and counts are taken from the
    written run. A failure leaves a failed job and run, and no cursor moves.
    """
    run_id = pipeline_run_id or run_ts
    end = run_time + dt.timedelta(milliseconds=1)  # the log orders a run's rows by time
    state.record_run(spark, layout.state, run_id, run_time, status="running", run_ts=run_ts, started_at=run_time)
    try:
        found = _land(spark, layout, pages, run_ts, run_time)
    except Exception as error:
        text = str(error)[:1000]
        state.record_job(spark, layout.state, "pages_to_bronze", "failed", 0, run_time, error=text, pipeline_run_id=run_id)
        state.record_run(spark, layout.state, run_id, end, status="failed", error=text, completed_at=end)
        raise
    state.record_job(spark, layout.state, "pages_to_bronze", "completed", found.records, run_time, pipeline_run_id=run_id)
    state.record_run(spark, layout.state, run_id, end, status="completed", completed_at=end)
    return found


def _land(spark, layout, pages, run_ts, run_time) -> Landing:
    resources = fhir.explode_bundles(fhir.read_bundle_pages(spark, pages))
    bronze.write_bronze(bronze.bronze_rows(resources, run_ts, run_time), layout.bronze, replace=True)
    stamp = parse_timestamp(F.from_json("resource_json", "meta struct<lastUpdated:string>")["meta"]["lastUpdated"])
    kinds = (
        bronze.read_bronze(spark, layout.bronze, run_ts=run_ts).groupBy("resource_type")
        .agg(F.count("*").alias("rows"), F.count_if(F.col("resource_id").isNull()).alias("without_id"), F.max(stamp).alias("newest"))
        .collect()
    )
    names = {r["resource_type"]: CURSOR.format(kind=r["resource_type"]) for r in kinds}
    known = state.get_cursors(spark, layout.state, list(names.values()))
    cursors = {
        names[r["resource_type"]]: max(t for t in (r["newest"], known.get(names[r["resource_type"]])) if t is not None)
        for r in kinds if r["newest"] is not None or names[r["resource_type"]] in known
    }
    state.set_run_state(spark, layout.state, STATE_ID, run_ts, run_time, types=sorted(names))
    state.set_cursors(spark, layout.state, cursors)
    metrics = [(f"bronze:{r['resource_type']}", m, r[m]) for r in kinds for m in ("rows", "without_id")]
    state.record_quality(spark, layout.state, metrics, run_time)
    return Landing(run_ts, sum(r["rows"] for r in kinds), cursors)
