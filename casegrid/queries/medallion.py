"""Bronze -> Silver: extraction round trips, dedupe, merges and the incremental step."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from casegrid.functions.dates import iso_utc
from casegrid.operators import dedupe
from casegrid.plans.bronze_to_silver import bronze_to_silver, silver_table
from casegrid.plans.csv_to_fhir import csv_to_fhir, orphans as find_orphans, wanted
from casegrid.plans.layout import Layout
from casegrid.plans.pages_to_bronze import pages_to_bronze
from casegrid.queries import data
from casegrid.queries.data import table
from casegrid.queries.registry import query
from casegrid.session import scratch_path
from casegrid.sources import bronze, fhir, state


@query("fhir_patient_roundtrip", "patients", sql="""
    SELECT patient_id, name, CASE WHEN dob <> 'bad' THEN dob END AS dob, gender, city, state, zipcode, 'US' AS country,
           latitude, longitude, '555-' || patient_id AS phone,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(patient_id AS BIGINT) % 86400), '%Y-%m-%dT%H:%M:%SZ') AS source_updated_at
    FROM patients""")
def fhir_patient_roundtrip(spark, sf):
    rows = fhir.extract_patients(data.patient_bronze(spark, sf), data.RUN_TIME)
    return rows.withColumn("source_updated_at", iso_utc(F.col("source_updated_at"))).drop("created_at", "updated_at")


@query("fhir_encounter_roundtrip", sql="""
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS encounter_id,
           CAST(l_suppkey AS VARCHAR) AS patient_id, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS encounter_date,
           CAST(l_partkey AS VARCHAR) AS provider_id,
           CASE WHEN l_linestatus = 'O' THEN 'flag ' ELSE 'text ' END || l_returnflag AS diagnosis
    FROM lineitem""")
def fhir_encounter_roundtrip(spark, sf):
    rows = fhir.extract_encounters(data.encounter_bronze(spark, sf), data.RUN_TIME)
    return rows.select(
        "encounter_id", "patient_id", iso_utc(F.col("encounter_date")).alias("encounter_date"), "provider_id", "diagnosis"
    )


@query("fhir_observation_roundtrip", sql="""
    SELECT CAST(event_id AS VARCHAR) AS obs_id, CAST(user_id AS VARCHAR) AS patient_id,
           CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 7 AS VARCHAR) END AS encounter_id,
           event_type AS observation_code,
           CASE WHEN event_id % 3 <> 0 THEN upper(event_type) ELSE 'free ' || event_type END AS observation_text,
           CAST(value AS VARCHAR) AS value, value AS value_num, 'u' AS unit,
           strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS observation_time
    FROM events""")
def fhir_observation_roundtrip(spark, sf):
    rows = fhir.extract_observations(data.observation_bronze(spark, sf), data.RUN_TIME)
    return rows.withColumn("observation_time", iso_utc(F.col("observation_time"))).drop(
        "created_at", "updated_at", "source_updated_at"
    )


@query("fhir_condition_roundtrip", "conditions", sql="""
    SELECT condition_id, patient_id, 'e1' AS encounter_id, condition_code, condition_text, 'active' AS clinical_status,
           'confirmed' AS verification_status, date_key AS condition_date
    FROM conditions""")
def fhir_condition_roundtrip(spark, sf):
    rows = fhir.extract_conditions(data.condition_bronze(spark, sf), data.RUN_TIME)
    return rows.withColumn("condition_date", F.date_format("condition_date", "yyyy-MM-dd")).drop(
        "created_at", "updated_at", "source_updated_at"
    )


@query("fhir_medreq_roundtrip", sql="""
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS medicationrequest_id,
           CAST(l_suppkey AS VARCHAR) AS patient_id, CAST(l_orderkey AS VARCHAR) AS encounter_id,
           CAST(l_partkey AS VARCHAR) AS medication_code,
           CASE WHEN l_linestatus = 'F' THEN 'coded' ELSE 'text ' || l_returnflag END AS medication_text,
           lower(l_linestatus) AS status, 'order' AS intent, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS authored_on
    FROM lineitem""")
def fhir_medreq_roundtrip(spark, sf):
    rows = fhir.extract_medication_requests(data.medication_bronze(spark, sf), data.RUN_TIME)
    return rows.withColumn("authored_on", iso_utc(F.col("authored_on"))).drop(
        "created_at", "updated_at", "source_updated_at"
    )


@query("bundle_explode", "conditions", sql="""
    SELECT condition_id AS resource_id, 'Condition' AS resource_type, condition_code FROM conditions""")
def bundle_explode(spark, sf):
    """Conditions packed into searchset pages of a hundred, landed as files, read back and exploded."""
    rows = data.condition_bronze(spark, sf)
    page = F.floor(F.col("resource_id").cast("bigint") / 100)
    entry = F.concat(F.lit('{"resource":'), F.col("resource_json"), F.lit("}"))
    pages = rows.groupBy(page.alias("page")).agg(F.collect_list(entry).alias("entries")).select(
        "page",
        F.concat(
            F.lit('{"resourceType":"Bundle","entry":[{"search":{"mode":"outcome"}},'),
            F.array_join("entries", ","), F.lit("]}"),
        ).alias("bundle_json"),
    )
    root = scratch_path(spark, "pages")
    pages.write.parquet(root)
    found = fhir.explode_bundles(spark.read.parquet(root).drop("page"))
    code = F.from_json("resource_json", "code struct<coding:array<struct<code:string>>>")["code"]["coding"]
    return found.select("resource_id", "resource_type", F.get(code, F.lit(0))["code"].alias("condition_code"))


@query("pages_to_bronze", "conditions", sql="""
    SELECT condition_id AS resource_id, 'Condition' AS resource_type, condition_code, '1706745600000' AS run_ts, true AS at_cursor
    FROM conditions""")
def pages_to_bronze_run(spark, sf):
    """Page files landed as a Bronze run, read back through the run state; nothing is newer than the cursor."""
    layout, root = Layout(scratch_path(spark, "landing")), scratch_path(spark, "page-files")
    rows = data.condition_bronze(spark, sf)
    entry = F.concat(F.lit('{"resource":'), F.col("resource_json"), F.lit("}"))
    pages = rows.groupBy(F.floor(F.col("resource_id").cast("bigint") / 100).alias("page")).agg(
        F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.array_join(F.collect_list(entry), ","), F.lit("]}")).alias("bundle_json")
    )
    fhir.write_bundle_pages(pages, root)
    pages_to_bronze(spark, layout, root, data.RUN_1, data.RUN_TIME)
    run = state.get_run_state(spark, layout.state, "bronze_latest_run")["run_ts"]
    cursor = state.get_cursors(spark, layout.state, ["pages_to_bronze:Condition"])["pages_to_bronze:Condition"]
    found = bronze.read_bronze(spark, layout.bronze, run_ts=run)
    body = F.from_json("resource_json", "code struct<coding:array<struct<code:string>>>, meta struct<lastUpdated:timestamp>")
    return found.withColumn("b", body).select(
        "resource_id", "resource_type", F.get("b.code.coding", F.lit(0))["code"].alias("condition_code"), "run_ts",
        (F.col("b.meta.lastUpdated") <= F.lit(cursor)).alias("at_cursor"),
    )


@query("batch_dedupe", sql="""
    SELECT CAST(user_id AS VARCHAR) AS patient_id, arg_max(event_type, event_id) AS observation_code,
           CAST(max(event_id) AS BIGINT) AS event_id
    FROM events GROUP BY user_id""")
def batch_dedupe(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("patient_id"), F.col("event_type").alias("observation_code"), "event_id",
    )
    return dedupe.latest_per_key(events, "patient_id", [F.col("event_id").desc()])


_MERGE = """
    SELECT CAST(user_id AS VARCHAR) AS patient_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS source_updated_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


def _update_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("patient_id"), "event_id", F.col("ts").alias("source_updated_at")
    )


@query("silver_merge", sql=_MERGE)
def silver_merge(spark, sf):
    """Two batches of updates, merged: each key keeps its newest version by source time."""
    rows = _update_rows(spark, sf)
    base = dedupe.latest_per_key(rows.where("event_id % 2 = 0"), "patient_id")
    delta = rows.where("event_id % 2 = 1")
    merged = dedupe.merge_snapshot(base, delta, "patient_id")
    return merged.withColumn("source_updated_at", iso_utc(F.col("source_updated_at")))


@query("silver_rejects", sql="""
    SELECT CASE WHEN event_id % 10 IN (0, 1) THEN 'rejected' ELSE 'kept' END AS outcome, count(*) AS n
    FROM events GROUP BY ALL""")
def silver_rejects(spark, sf):
    """Rows without a usable key leave the batch into a rejects table instead of collapsing into one."""
    key = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, "").otherwise(
        F.col("event_id").cast("string")
    )
    kept, rejected = dedupe.split_rejects(table(spark, sf, "events").withColumn("obs_id", key), "obs_id")
    return kept.select(F.lit("kept").alias("outcome")).unionByName(
        rejected.select(F.lit("rejected").alias("outcome"))
    ).groupBy("outcome").agg(F.count("*").alias("n"))


_CURSOR = dt.datetime(2024, 1, 16)


@query("incremental_delta", sql="""
    SELECT event_type AS resource_type, count(*) AS delta_rows, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS next_cursor
    FROM events WHERE ts > TIMESTAMP '2024-01-16 00:00:00' GROUP BY event_type""")
def incremental_delta(spark, sf):
    rows = table(spark, sf, "events").where(bronze.newer_than(F.col("ts"), _CURSOR))
    return rows.groupBy(F.col("event_type").alias("resource_type")).agg(
        F.count("*").alias("delta_rows"), iso_utc(F.max("ts")).alias("next_cursor")
    )


@query("latest_resource_ts", "conditions", sql="""
    SELECT strftime(max(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(condition_id AS BIGINT) % 86400)), '%Y-%m-%dT%H:%M:%SZ') AS latest
    FROM conditions""")
def latest_resource_ts(spark, sf):
    newest = fhir.latest_source_time(data.condition_bronze(spark, sf), dt.datetime(2020, 1, 1))
    return newest.select(iso_utc(F.col("latest")).alias("latest"))


@query("per_type_cap", sql="""
    SELECT event_type, event_id FROM (
        SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
    WHERE rn <= 50""")
def per_type_cap(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    return dedupe.cap_per_group(rows, "event_type", 50, [F.col("event_id")])


@query("wanted_patients", sql="""
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def wanted_patients(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("Id"), "c_name")
    selected = data.conditions(spark, sf).where("condition_code = '1-URGENT'")
    return wanted(people, "Id", selected, "patient_id").select(F.col("Id").cast("bigint").alias("c_custkey"), "c_name")


@query("orphan_conditions", sql="""
    SELECT CAST(o_orderkey AS VARCHAR) AS condition_id FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
       OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def orphan_conditions(spark, sf):
    selected = data.conditions(spark, sf).withColumn("encounter_id", F.col("condition_id"))
    people = table(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("Id"))
    stays = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("Id"))
    return find_orphans(selected, people, stays).select("condition_id")


def _two_runs(spark, sf):
    """Two Bronze runs of patients; the second one renames every third patient and has no conditions."""
    layout = Layout(scratch_path(spark, "medallion"))
    people = data.patients(spark, sf)
    first = data.patient_bronze(spark, sf, people).unionByName(data.condition_bronze(spark, sf))
    bronze.write_bronze(bronze.bronze_rows(first, data.RUN_1, dt.datetime(2024, 2, 1, 6)), layout.bronze)
    bronze_to_silver(spark, layout, dt.datetime(2024, 2, 1, 7), data.RUN_1)
    third = people.where(F.col("patient_id").cast("bigint") % 3 == 0).withColumn("name", F.concat(F.lit("new "), "name"))
    later = data.patient_bronze(spark, sf, third).withColumn(
        "resource_json", F.regexp_replace("resource_json", '"lastUpdated":"2024-01', '"lastUpdated":"2024-03')
    )
    bronze.write_bronze(bronze.bronze_rows(later, data.RUN_2, dt.datetime(2024, 2, 2, 6)), layout.bronze)
    return layout, bronze_to_silver(spark, layout, dt.datetime(2024, 2, 2, 7), data.RUN_2)


@query("incremental_step", "patients", sql="""
    SELECT patient_id, CASE WHEN CAST(patient_id AS BIGINT) % 3 = 0 THEN 'new ' ELSE '' END || name AS name,
           CASE WHEN CAST(patient_id AS BIGINT) % 3 = 0 THEN '2024-02-02T06:00:00Z' ELSE '2024-02-01T06:00:00Z' END AS created_at
    FROM patients""")
def incremental_step(spark, sf):
    layout, _ = _two_runs(spark, sf)
    rows = silver_table(spark, layout, "patient", data.RUN_2)
    return rows.select("patient_id", "name", iso_utc(F.col("created_at")).alias("created_at"))


@query("incremental_backlog", "patients", sql="""
    SELECT patient_id, CASE CAST(patient_id AS BIGINT) % 4 WHEN 0 THEN 'second ' WHEN 1 THEN 'third ' WHEN 2 THEN 'late ' ELSE 'again ' END || name AS name
    FROM patients UNION ALL SELECT CAST(CAST(patient_id AS BIGINT) + 10000000 AS VARCHAR), name FROM patients WHERE CAST(patient_id AS BIGINT) % 4 = 1""")
def incremental_backlog(spark, sf):
    """Three landings meet one step, an older one that came late is named in another, and the first is landed again."""
    layout, people = Layout(scratch_path(spark, "backlog")), data.patients(spark, sf)
    renamed = lambda k, word: people.where(F.col("patient_id").cast("bigint") % 4 == k).withColumn("name", F.concat(F.lit(word + " "), "name"))

    def land(rows, run_ts, day, month):
        stamped = data.patient_bronze(spark, sf, rows).withColumn(
            "resource_json", F.regexp_replace("resource_json", '"lastUpdated":"2024-01', f'"lastUpdated":"2024-{month}')
        )
        bronze.write_bronze(bronze.bronze_rows(stamped, run_ts, dt.datetime(2024, 2, day, 6)), layout.bronze)

    land(people, data.RUN_1, 1, "01")
    land(renamed(0, "second"), data.RUN_2, 2, "03")
    land(renamed(1, "third"), "manual", 3, "03")
    bronze_to_silver(spark, layout, dt.datetime(2024, 2, 4, 7))
    land(renamed(2, "late"), "1700000000000", 1, "03")
    bronze_to_silver(spark, layout, dt.datetime(2024, 2, 5, 7), "1700000000000")
    # The oldest run is replaced: a quarter of its patients is repaired, others are new, the rest is gone from it.
    k = F.col("patient_id").cast("bigint")
    fresh = people.where(k % 4 == 1).withColumn("patient_id", (k + 10_000_000).cast("string"))
    stamped = data.patient_bronze(spark, sf, renamed(3, "again").unionByName(fresh))
    stamped = stamped.withColumn("resource_json", F.regexp_replace("resource_json", '"lastUpdated":"2024-01', '"lastUpdated":"2024-04'))
    bronze.write_bronze(bronze.bronze_rows(stamped, data.RUN_1, dt.datetime(2024, 2, 6, 6)), layout.bronze, replace=True)
    bronze_to_silver(spark, layout, dt.datetime(2024, 2, 6, 7))
    return silver_table(spark, layout, "patient").select("patient_id", "name")


@query("carry_forward", "conditions", sql="""
    SELECT condition_id, condition_code, '1706832000000' AS run_ts FROM conditions""")
def carry_forward(spark, sf):
    """The second run brings no conditions: its Silver state points at the first run's snapshot."""
    layout, result = _two_runs(spark, sf)
    assert "condition" in result.carried_forward
    rows = silver_table(spark, layout, "condition", result.run_ts)
    return rows.select("condition_id", "condition_code", F.lit(result.run_ts).alias("run_ts"))




def _csv_inputs(spark, sf):
    stays = table(spark, sf, "orders").select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("Id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("START"),
        F.lit(None).cast("string").alias("STOP"), F.lit("wellness").alias("ENCOUNTERCLASS"),
        F.col("o_orderstatus").alias("CODE"), F.lit("Visit").alias("DESCRIPTION"),
    )
    people = data.patients(spark, sf).select(
        F.col("patient_id").alias("Id"), F.col("name").alias("FIRST"), F.lit(None).cast("string").alias("LAST"),
        F.col("gender").alias("GENDER"), F.col("dob").alias("BIRTHDATE"), F.lit("1 Main St").alias("ADDRESS"),
        F.col("city").alias("CITY"), F.col("state").alias("STATE"), F.col("zipcode").alias("ZIP"),
        F.col("latitude").cast("string").alias("LAT"), F.col("longitude").cast("string").alias("LON"),
    )
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("source_index"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("START"), F.lit(None).cast("string").alias("STOP"),
        F.col("o_custkey").cast("string").alias("PATIENT"),
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("ENCOUNTER"),
        F.col("o_orderpriority").alias("CODE"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("Sars "), "o_orderpriority"))
        .otherwise("other").alias("DESCRIPTION"),
    )
    return rows, people, stays


_TARGET = (dt.datetime(2026, 1, 1), dt.datetime(2026, 12, 31, 23, 59, 59))


@query("csv_to_fhir")
def csv_conversion(spark, sf):
    return csv_to_fhir(*_csv_inputs(spark, sf), _TARGET).bundles


@query("bundle_build", sql="""
    WITH s AS (SELECT *, epoch_us(o_orderdate) AS us FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
    b AS (SELECT min(us) AS lo, max(us) AS hi FROM s),
    t AS (SELECT epoch_us(TIMESTAMP '2026-01-01 00:00:00') AS dlo, epoch_us(TIMESTAMP '2026-12-31 23:59:59') AS dhi)
    SELECT CAST(o_custkey AS VARCHAR) || ':e' || CAST(o_orderkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS bundle_id,
           CAST(3 AS BIGINT) AS entries, 'Encounter?identifier=urn:casegrid:encounter|e' || CAST(o_orderkey AS VARCHAR) AS encounter_url,
           'POST' AS condition_method, 'active' AS clinical_status, o_orderpriority AS code, 'Sars ' || o_orderpriority AS display,
           strftime(make_timestamp(dlo + CAST(round((us - lo) / CAST(hi - lo AS DOUBLE) * (dhi - dlo)) AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS recorded
    FROM s, b, t""")
def bundle_build(spark, sf):
    bundles = csv_to_fhir(*_csv_inputs(spark, sf), _TARGET).bundles
    shape = (
        "entry array<struct<request:struct<method:string,url:string>, resource:struct<recordedDate:string,"
        "clinicalStatus:struct<coding:array<struct<code:string>>>,"
        "code:struct<coding:array<struct<code:string,display:string>>>>>>"
    )
    e = lambda i: F.get(F.col("b.entry"), F.lit(i))
    coding = F.get(e(2)["resource"]["code"]["coding"], F.lit(0))
    return bundles.withColumn("b", F.from_json("bundle_json", shape)).select(
        "bundle_id",
        F.size("b.entry").cast("bigint").alias("entries"),
        e(1)["request"]["url"].alias("encounter_url"),
        e(2)["request"]["method"].alias("condition_method"),
        F.get(e(2)["resource"]["clinicalStatus"]["coding"], F.lit(0))["code"].alias("clinical_status"),
        coding["code"].alias("code"),
        coding["display"].alias("display"),
        e(2)["resource"]["recordedDate"].alias("recorded"),
    )


@query("rows_processed", sql="""
    SELECT count(*) AS written, count(*) AS observed,
           strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM events""")
def rows_processed(spark, sf):
    """Row count and newest timestamp collected while the rows are written."""
    from casegrid.operators.quality import observed

    rows, seen = observed(table(spark, sf, "events"), "events_written", F.max("ts").alias("newest"))
    path = scratch_path(spark, "observed")
    rows.write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("written")).select(
        "written", F.lit(seen.get["rows"]).alias("observed"),
        iso_utc(F.lit(seen.get["newest"]).cast("timestamp")).alias("newest"),
    )


