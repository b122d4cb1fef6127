"""Silver -> Gold step."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.functions import geo
from casegrid.operators import deltas, gold as ops
from casegrid.operators.quality import unlocated_patients
from casegrid.plans.bronze_to_silver import silver_table
from casegrid.plans.layout import Layout
from casegrid.session import scratch_path
from casegrid.sources import gold, silver, state

STATE_ID = "gold_latest_run"


def silver_to_gold(
    spark: SparkSession,
    layout: Layout,
    as_of: dt.date,
    run_time: dt.datetime,
    silver_ts: str | None = None,
    parity: bool = False,
    resolution: int = geo.DEFAULT_RESOLUTION,
    pipeline_run_id: str | None = None,
) -> str:
    """Count cases of one Silver snapshot and publish fact and dimensions. Returns the fact's path.

    The default replaces the fact, so groups that became empty vanish. ``parity=True`` upserts into
    the existing fact and never removes a key. The join and the count run once: the dimensions are
    derived from the fact that was just written.
    """
    base = state.snapshot(spark, layout.state)
    patients = silver_table(spark, layout, "patient", silver_ts)
    conditions = silver_table(spark, layout, "condition", silver_ts)
    if patients is None or conditions is None:
        raise FileNotFoundError("patient or condition snapshot is missing")
    fact = ops.gold_fact(conditions, patients, as_of, resolution)
    if parity:
        published = read_published(spark, layout)
        fact = ops.upsert_fact(published and published["fact"], fact)
    texts = None if parity else ops.condition_texts(conditions)
    counts = unlocated_patients(patients).first()
    state.record_quality(spark, layout.state, [("patient", name, counts[name]) for name in ("patients", "unlocated")], run_time)
    path = gold.write_fact(fact, layout.gold)
    cells = ops.condition_cells(gold.open_fact(spark, path))
    return publish(spark, layout, base, path, cells, texts, run_time, parity, as_of, pipeline_run_id)


def read_published(spark: SparkSession, layout: Layout, condition_code: str | None = None) -> dict[str, DataFrame] | None:
    """Fact and dimensions of the published state, all of one publication; None before the first."""
    pointer = state.get_run_state(spark, layout.state, STATE_ID)
    if pointer is None:
        return None
    fact = gold.open_fact(spark, pointer["path"], None if condition_code is None else [condition_code])
    return {"fact": fact} | {
        name: spark.read.schema(gold.DIMENSIONS[name]).parquet(path) for name, path in pointer["dimensions"].items()
    }


def publish(spark, layout, base, path, cells, texts, run_time, keep_old_dimensions, as_of, pipeline_run_id=None) -> str:
    """Write the dimensions of a fact that is written, then one commit that names all of them.

    It is refused if Gold has been published since ``base`` was read. ``cells`` are the cases per condition and cell, ``texts`` the texts per condition (None: labels stay codes).
    """
    before = read_published(spark, layout) if keep_old_dimensions else None
    old = [before[name] if before else None for name in (gold.CONDITIONS, gold.CELLS)]
    stamp, dimensions = run_time.isoformat(), {}

    def write(df, name):
        dimensions[name] = gold.write_dimension(df, layout.gold, name)
        return spark.read.schema(gold.DIMENSIONS[name]).parquet(dimensions[name])

    cells = write(cells, gold.CONDITION_CELLS)
    labels = None if texts is None else ops.labels_of(write(texts, gold.CONDITION_TEXTS))
    write(ops.conditions_dim(cells, stamp, labels, old[0]), gold.CONDITIONS)
    write(ops.cells_dim(cells, stamp, old[1]), gold.CELLS)
    pointed = state.run_state_change(
        STATE_ID, path.rsplit("=", 1)[-1], run_time, path=path, dimensions=dimensions, as_of=as_of.isoformat()
    )
    state.publish(spark, layout.state, base, pointed, (state.state_name(STATE_ID),))
    cases = cells.groupBy().sum("case_count").first()[0] or 0
    state.record_job(
        spark, layout.state, "silver_to_gold", "completed", cases, run_time, pipeline_run_id=pipeline_run_id
    )
    return path


def refresh_gold(
    spark: SparkSession,
    layout: Layout,
    before: dict[str, str],
    after: dict[str, str],
    as_of: dt.date,
    run_time: dt.datetime,
    resolution: int = geo.DEFAULT_RESOLUTION,
) -> str:
    """Move the published fact to another published Silver state (table -> path), by signed rows.

    Only the buckets in which the two states differ are read from both. Patients who have aged into
    another group since the published fact was counted are found in one scan. Only the conditions that
    the changes touch are read from the fact and written; the others are taken over, in the fact as in
    the counts behind the dimensions.
    """
    def whole(paths, table):
        return silver.open_snapshot(spark, paths[table], table) if table in paths else silver.empty(spark, table)

    def differing(table):
        """The rows of both states that may differ, and those of the new one that do not."""
        buckets, alike = silver.differing_buckets(spark, before.get(table), after.get(table))
        if not alike:
            return whole(before, table), whole(after, table), silver.empty(spark, table)
        shared = set(silver.manifest(spark, after[table])["folders"]) - buckets
        return tuple(silver.open_snapshot(spark, p[table], table, b) for p, b in ((before, buckets), (after, buckets), (after, shared)))

    base = state.snapshot(spark, layout.state)
    pointer = state.run_state(base, STATE_ID)
    conditions, patients = whole(after, "condition"), whole(after, "patient")
    if pointer is None or "as_of" not in pointer or gold.CONDITION_TEXTS not in pointer["dimensions"]:
        path = gold.write_fact(ops.gold_fact(conditions, patients, as_of, resolution), layout.gold)
        cells = ops.condition_cells(gold.open_fact(spark, path))
        return publish(spark, layout, base, path, cells, ops.condition_texts(conditions), run_time, False, as_of)

    counted_on = dt.date.fromisoformat(pointer["as_of"])
    old, new, _ = differing("condition")
    condition_changes = _written(deltas.signed_changes(deltas.condition_forms(old), deltas.condition_forms(new)), "condition-changes")
    old, new, shared = differing("patient")
    moved = deltas.signed_changes(ops.located_patients(old, counted_on, resolution), ops.located_patients(new, as_of, resolution))
    if counted_on != as_of:
        moved = moved.unionByName(deltas.aged_patients(shared, counted_on, as_of, resolution))
    patient_changes = _written(moved, "patient-changes")

    changes = _written(
        deltas.signed_cases(
            condition_changes, patient_changes, ops.dated_conditions(whole(before, "condition")),
            ops.located_patients(patients, as_of, resolution), resolution,
        ),
        "fact-changes",
    )
    # As many codes as there are conditions, at most.
    codes = [row[0] for row in changes.select("condition_code").distinct().collect()]
    existing = gold.open_fact(spark, pointer["path"], codes)
    lost = _written(deltas.lost_places(existing, changes), "lost-places")
    places = None if lost.isEmpty() else deltas.recounted_places(lost, conditions, patients, as_of, resolution)
    path = gold.write_changes(deltas.apply_changes(existing, changes, places), layout.gold, pointer["path"], codes)

    published = {name: spark.read.schema(gold.DIMENSIONS[name]).parquet(p) for name, p in pointer["dimensions"].items()}
    touched = spark.createDataFrame([(code,) for code in codes], "condition_code string")
    cells = published[gold.CONDITION_CELLS].join(F.broadcast(touched), "condition_code", "left_anti")
    cells = cells.unionByName(ops.condition_cells(gold.open_fact(spark, path, codes)))
    texts = published[gold.CONDITION_TEXTS].unionByName(ops.condition_texts(condition_changes))
    texts = texts.groupBy("condition_code", "condition_text").agg(F.sum("n").alias("n")).where("n > 0")
    return publish(spark, layout, base, path, cells, texts, run_time, False, as_of)


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a change, written once; read again, their size is known to whatever joins them."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)
