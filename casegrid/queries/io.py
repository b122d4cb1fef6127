"""Sources and sinks: written to a fresh folder below the shared one, read back and compared."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from casegrid.functions.dates import iso_utc
from casegrid.operators import gold
from casegrid.queries import data
from casegrid.queries.data import table
from casegrid.queries.registry import query
from casegrid.session import scratch_path
from casegrid.sources import bronze, csvs, exports, silver
from casegrid.sources import gold as gold_store

_NOON = dt.datetime(2024, 2, 1, 12)


def _event_resources(spark, sf):
    """Events as raw rows: the event type as resource type, missing for sign-ups."""
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("resource_id"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("resource_type"),
        F.col("props").alias("resource_json"),
        F.col("event_id"),
    )


def _two_bronze_runs(spark, sf):
    root = scratch_path(spark, "bronze")
    rows = _event_resources(spark, sf)
    bronze.write_bronze(bronze.bronze_rows(rows.where("event_id % 2 = 0"), data.RUN_1, _NOON), root)
    bronze.write_bronze(bronze.bronze_rows(rows.where("event_id % 2 = 1"), data.RUN_2, _NOON + dt.timedelta(days=1)), root)
    return root


@query("bronze_sink", sql="""
    SELECT CAST(event_id AS VARCHAR) AS resource_id, CASE WHEN event_type = 'signup' THEN 'Unknown' ELSE event_type END AS resource_type,
           CASE WHEN event_id % 2 = 0 THEN '20240201' ELSE '20240202' END AS ingestion_date,
           CASE WHEN event_id % 2 = 0 THEN '1706745600000' ELSE '1706832000000' END AS run_ts, props AS resource_json
    FROM events""")
def bronze_sink(spark, sf):
    root = _two_bronze_runs(spark, sf)
    return bronze.read_bronze(spark, root).select("resource_id", "resource_type", "ingestion_date", "run_ts", "resource_json")


@query("bronze_readback", sql="""
    SELECT CAST(event_id AS VARCHAR) AS resource_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_type = 'click' AND event_id % 2 = 1""")
def bronze_readback(spark, sf):
    rows = bronze.read_bronze(spark, _two_bronze_runs(spark, sf), "click", date="20240202")
    return rows.select("resource_id", F.from_json("resource_json", "k bigint")["k"].alias("k"))


@query("scan_run", sql="""
    SELECT CAST(event_id AS VARCHAR) AS resource_id, '1706832000000' AS run_ts FROM events WHERE event_type = 'view' AND event_id % 2 = 1""")
def scan_run(spark, sf):
    """Both runs hold the type; the cursor is before the second run only."""
    rows = bronze.read_bronze(spark, _two_bronze_runs(spark, sf), "view", data.RUN_2, since=_NOON)
    return rows.select("resource_id", "run_ts")


@query("latest_run_scan", sql="""
    SELECT CAST(event_id AS VARCHAR) AS resource_id FROM events WHERE event_id % 2 = 1""")
def latest_run_scan(spark, sf):
    root = _two_bronze_runs(spark, sf)
    return bronze.read_bronze(spark, root, run_ts=bronze.latest_run(spark, root)).select("resource_id")


def _condition_snapshots(spark, sf):
    root = scratch_path(spark, "silver")
    rows = data.conditions(spark, sf)
    silver.write_snapshot(rows.where("condition_code = '1-URGENT'"), root, "condition", data.RUN_1)
    silver.write_snapshot(rows, root, "condition", data.RUN_2)
    return root


_CONDITIONS = "SELECT condition_id, patient_id, condition_code, condition_text, date_key AS condition_date FROM conditions"


def _shown(rows):
    return rows.select(
        "condition_id", "patient_id", "condition_code", "condition_text",
        F.date_format("condition_date", "yyyy-MM-dd").alias("condition_date"),
    )


@query("silver_sink", "conditions", sql=_CONDITIONS)
def silver_sink(spark, sf):
    root = scratch_path(spark, "silver")
    silver.write_snapshot(data.conditions(spark, sf), root, "condition", data.RUN_1)
    return _shown(silver.read_snapshot(spark, root, "condition", data.RUN_1))


@query("silver_current", "conditions", sql=_CONDITIONS)
def silver_current(spark, sf):
    """An unknown run id falls back to the latest snapshot, never to all of them."""
    return _shown(silver.read_current(spark, _condition_snapshots(spark, sf), "condition", "1"))


@query("snapshot_concat", "conditions", sql=f"""
    {_CONDITIONS} UNION ALL {_CONDITIONS} WHERE condition_code = '1-URGENT'""")
def snapshot_concat(spark, sf):
    return _shown(silver.read_history(spark, _condition_snapshots(spark, sf), "condition"))


@query("absent_snapshot", "conditions", sql=_CONDITIONS)
def absent_snapshot(spark, sf):
    """A run without a snapshot has no rows; merging nothing changes nothing."""
    root = _condition_snapshots(spark, sf)
    assert silver.read_snapshot(spark, root, "condition", "1706900000000") is None
    current = silver.read_current(spark, root, "condition")
    return _shown(current.unionByName(silver.empty(spark, "condition")))


@query("gold_sink", "fact", sql="SELECT * FROM fact")
def gold_sink(spark, sf):
    root = scratch_path(spark, "gold")
    gold_store.write_fact(data.fact(spark, sf), root)
    return gold_store.read_fact(spark, root)


@query("gold_partition_scan", "fact", sql="""
    SELECT h3, CAST(sum(case_count) AS BIGINT) AS case_count FROM fact WHERE condition_code = '4-NOT SPECIFIED' GROUP BY h3""")
def gold_partition_scan(spark, sf):
    """The raw code, with its space, is the partition value; other conditions are not opened."""
    root = scratch_path(spark, "gold")
    gold_store.write_fact(data.fact(spark, sf), root)
    rows = gold_store.read_fact(spark, root, "4-NOT SPECIFIED")
    return rows.groupBy("h3").agg(F.sum("case_count").alias("case_count"))


@query("gold_partition_replace", "fact", sql="""
    SELECT condition_code, date_key, h3, age_group, gender,
           case_count + CASE WHEN condition_code = '2-HIGH' THEN 1000 ELSE 0 END AS case_count, city, state FROM fact""")
def gold_partition_replace(spark, sf):
    root = scratch_path(spark, "gold")
    fact = data.fact(spark, sf)
    path = gold_store.write_fact(fact, root)
    changed = fact.where("condition_code = '2-HIGH'").withColumn("case_count", F.col("case_count") + 1000)
    gold_store.replace_conditions(changed, path)
    return gold_store.read_fact(spark, root)


@query("gold_export", "fact", sql="""
    SELECT replace(condition_code, ' ', '_') AS condition, condition_code, CAST(sum(case_count) AS BIGINT) AS case_count FROM fact GROUP BY ALL""")
def gold_export(spark, sf):
    path = scratch_path(spark, "export")
    gold_store.export_fact(data.fact(spark, sf), path)
    return spark.read.parquet(path).groupBy("condition", "condition_code").agg(F.sum("case_count").alias("case_count"))


@query("dimension_scan", "fact", sql="""
    SELECT 'condition' AS kind, condition_code AS id, CAST(sum(case_count) AS BIGINT) AS cases, CAST(count(*) OVER () AS INTEGER) AS total
    FROM fact GROUP BY condition_code
    UNION ALL SELECT 'cell', h3, NULL, CAST(count(*) OVER () AS INTEGER) FROM fact GROUP BY h3""")
def dimension_scan(spark, sf):
    """Both dimensions of a published fact, as their readers give them."""
    root, fact = scratch_path(spark, "gold"), data.published_fact(spark, sf)
    gold_store.write_dimension(gold.conditions_dim(fact, data.STAMP), root, gold_store.CONDITIONS)
    gold_store.write_dimension(gold.cells_dim(fact, data.STAMP), root, gold_store.CELLS)
    codes = gold_store.read_dimension(spark, root, gold_store.CONDITIONS).select(
        F.lit("condition").alias("kind"), F.col("condition_code").alias("id"), F.col("patient_count").alias("cases"),
        F.col("total_unique").cast("int").alias("total"),
    )
    cells = gold_store.read_dimension(spark, root, gold_store.CELLS).select(
        F.lit("cell").alias("kind"), F.col("h3").alias("id"), F.lit(None).cast("bigint").alias("cases"),
        F.col("total_unique").cast("int").alias("total"),
    )
    return codes.unionByName(cells)


@query("jsonl_sink", "dense_fact", sql="SELECT * FROM dense_fact")
def jsonl_sink(spark, sf):
    from casegrid import schemas

    path = scratch_path(spark, "jsonl")
    gold_store.export_daily_json(data.dense_fact(spark, sf), path)
    return spark.read.schema(schemas.GOLD_FACT).json(path).drop("condition", "day")


@query("json_metadata", "fact", sql="""
    SELECT 'cell' AS kind, h3 AS id, CAST(sum(case_count) AS BIGINT) AS cases, count(*) OVER () AS total_unique FROM fact GROUP BY h3
    UNION ALL
    SELECT 'condition', condition_code, CAST(sum(case_count) AS BIGINT), count(*) OVER () FROM fact GROUP BY condition_code""")
def json_metadata(spark, sf):
    """Both dimensions written as JSON lines and read back; cells joined to the fact they describe."""
    fact = data.published_fact(spark, sf)
    cells, conditions = scratch_path(spark, "cells"), scratch_path(spark, "conditions")
    exports.write_lines(exports.cells_lines(gold.cells_dim(fact, data.STAMP), data.STAMP), cells)
    exports.write_lines(exports.conditions_lines(gold.conditions_dim(fact, data.STAMP), data.STAMP), conditions)
    known = spark.read.schema("h3 string, latitude double, longitude double, total_unique bigint").json(cells)
    codes = spark.read.schema("condition_code string, patient_count bigint, total_unique bigint").json(conditions)
    totals = fact.groupBy("h3").agg(F.sum("case_count").alias("cases"))
    return totals.join(known.where("latitude is not null"), "h3").select(F.lit("cell").alias("kind"), F.col("h3").alias("id"), "cases", "total_unique").unionByName(
        codes.select(F.lit("condition").alias("kind"), F.col("condition_code").alias("id"), F.col("patient_count").alias("cases"), "total_unique")
    )


@query("csv_scan", "conditions", sql="""
    SELECT 'id,' || patient_id AS patient, condition_code AS code, condition_text || ' "quoted", text' AS description FROM conditions""")
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    data.conditions(spark, sf).select(
        F.lit("x").alias("EXTRA"),
        F.concat(F.lit("id,"), "patient_id").alias("PATIENT"),
        F.col("condition_code").alias("CODE"),
        F.concat("condition_text", F.lit(' "quoted", text')).alias("DESCRIPTION"),
        F.lit("e").alias("ENCOUNTER"), F.date_format("condition_date", "yyyy-MM-dd").alias("START"), F.lit("").alias("STOP"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return csvs.read_csv(spark, path, "conditions").select(
        F.col("PATIENT").alias("patient"), F.col("CODE").alias("code"), F.col("DESCRIPTION").alias("description")
    )


@query("city_scan", "cities", sql="""
    SELECT city, iso2, lat, lng, population FROM cities
    WHERE population >= 100000 AND lat BETWEEN -90 AND 90 ORDER BY population DESC, city LIMIT 500""")
def city_scan(spark, sf):
    path = scratch_path(spark, "cities")
    data.cities(spark, sf).write.option("header", True).csv(path)
    found = csvs.read_cities(spark, path, max_cities=500, min_population=100_000)
    return found.select("city", "iso2", "lat", "lng", "population")


@query("csv_row_numbers", "conditions", sql="""
    SELECT CAST(row_number() OVER (ORDER BY CAST(condition_id AS BIGINT)) AS BIGINT) AS source_index, condition_id FROM conditions""")
def csv_row_numbers(spark, sf):
    """Row positions of a CSV file set, in file and line order."""
    from casegrid.plans.csv_to_fhir import number_rows

    path = scratch_path(spark, "numbered")
    data.conditions(spark, sf).select("condition_id").orderBy(F.col("condition_id").cast("bigint")).write.csv(path)
    return number_rows(spark.read.schema("condition_id string").csv(path)).select("source_index", "condition_id")


@query("event_time_text", sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ingested FROM events")
def event_time_text(spark, sf):
    """Timestamps keep their type through a write, instead of turning into text."""
    path = scratch_path(spark, "native")
    table(spark, sf, "events").select("event_id", "ts").write.parquet(path)
    return spark.read.schema("event_id bigint, ts timestamp").parquet(path).select("event_id", iso_utc(F.col("ts")).alias("ingested"))


