"""The incremental steps as streams; their results equal those of the batch jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from casegrid.plans.bronze_to_silver import silver_table
from casegrid.plans.layout import Layout
from casegrid.queries import data
from casegrid.queries.registry import query
from casegrid.session import scratch_path
from casegrid.sources import bronze
from casegrid.sources import gold as gold_store
from casegrid.streaming.incremental import stream_gold, stream_silver


def _clock():
    """A clock that moves a minute per reading, so that runs are ordered."""
    now = [data.RUN_TIME]

    def tick() -> dt.datetime:
        now[0] += dt.timedelta(minutes=1)
        return now[0]

    return tick


def _land(layout, rows, run_ts, at):
    bronze.write_bronze(bronze.bronze_rows(rows, run_ts, at), layout.bronze)


def _drain(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


def _renamed(people):
    return people.where(F.col("patient_id").cast("bigint") % 4 == 0).withColumn("name", F.concat(F.lit("new "), "name"))


def _later(rows):
    return rows.withColumn("resource_json", F.regexp_replace("resource_json", '"lastUpdated":"2024-01', '"lastUpdated":"2024-03'))


@query("stream_upsert", "patients", sql="""
    SELECT patient_id, CASE WHEN CAST(patient_id AS BIGINT) % 4 = 0 THEN 'new ' ELSE '' END || name AS name FROM patients""")
def stream_upsert(spark, sf):
    """Two landings, two runs of the stream over one checkpoint: latest version per patient."""
    layout, checkpoint, clock = Layout(scratch_path(spark, "stream")), scratch_path(spark, "stream-checkpoint"), _clock()
    people = data.patients(spark, sf)
    _land(layout, data.patient_bronze(spark, sf, people), data.RUN_1, dt.datetime(2024, 2, 1, 6))
    _drain(stream_silver(spark, layout, checkpoint, clock=clock))
    _land(layout, _later(data.patient_bronze(spark, sf, _renamed(people))), data.RUN_2, dt.datetime(2024, 2, 2, 6))
    _drain(stream_silver(spark, layout, checkpoint, clock=clock))
    return silver_table(spark, layout, "patient").select("patient_id", "name")


@query("stream_gold", "patients", "conditions", sql=f"""
    WITH moved AS (SELECT * REPLACE (CASE WHEN CAST(patient_id AS BIGINT) % 4 = 0 THEN latitude + 2 ELSE latitude END AS latitude,
                                     CASE WHEN dob = 'bad' THEN NULL ELSE dob END AS dob) FROM patients)
    {data.fact_sql('conditions', 'moved', data.LATER)}""")
def stream_gold_refresh(spark, sf):
    """Patients move in the second landing, and all are older: groups they left and joined are recounted."""
    layout, checkpoint, clock = Layout(scratch_path(spark, "stream")), scratch_path(spark, "stream-checkpoint"), _clock()
    people = data.patients(spark, sf)
    first = data.patient_bronze(spark, sf, people).unionByName(data.condition_bronze(spark, sf))
    _land(layout, first, data.RUN_1, dt.datetime(2024, 2, 1, 6))
    _drain(stream_gold(spark, layout, checkpoint, data.AS_OF, clock=clock))
    moved = people.where(F.col("patient_id").cast("bigint") % 4 == 0).withColumn("latitude", F.col("latitude") + 2)
    _land(layout, _later(data.patient_bronze(spark, sf, moved)), data.RUN_2, dt.datetime(2024, 2, 2, 6))
    _drain(stream_gold(spark, layout, checkpoint, data.LATER, clock=clock))
    return gold_store.read_fact(spark, layout.gold)


@query("gold_job", "patients", "conditions", sql=f"{data.fact_sql('conditions', 'patients')}")
def gold_job(spark, sf):
    """Bronze to Gold with the batch jobs, one run."""
    from casegrid.plans.bronze_to_silver import bronze_to_silver
    from casegrid.plans.silver_to_gold import silver_to_gold

    layout = Layout(scratch_path(spark, "jobs"))
    rows = data.patient_bronze(spark, sf).unionByName(data.condition_bronze(spark, sf))
    _land(layout, rows, data.RUN_1, dt.datetime(2024, 2, 1, 6))
    bronze_to_silver(spark, layout, data.RUN_TIME)
    silver_to_gold(spark, layout, data.AS_OF, data.RUN_TIME)
    return gold_store.read_fact(spark, layout.gold)
