"""Statistics, checks, expectations and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.operators import gold, manifest, quality
from casegrid.queries import data
from casegrid.queries.data import table
from casegrid.queries.registry import query
from casegrid.session import scratch_path
from casegrid.sources import gold as gold_store


@query("table_stats", sql="""
    SELECT CAST(1 AS BIGINT) AS file_count, count(*) AS row_count, CAST(sum(l_linenumber) AS DOUBLE) AS sum_l_linenumber FROM lineitem""")
def table_stats(spark, sf):
    return quality.table_stats(table(spark, sf, "lineitem"), ["l_linenumber"])


@query("min_files_rows", sql="""
    SELECT 'row_count_min' AS "check", count(*) AS found, CAST(100 AS BIGINT) AS required, count(*) >= 100 AS passed FROM lineitem
    UNION ALL SELECT 'file_count_min', 1, 2, false FROM lineitem HAVING count(*) > 0""")
def min_files_rows(spark, sf):
    stats = quality.table_stats(table(spark, sf, "lineitem"), [])
    return quality.combine_checks(
        quality.check_minimum(stats, "row_count", 100), quality.check_minimum(stats, "file_count", 2)
    )


@query("idempotence", "fact", sql="""
    SELECT 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS left_value, CAST(count(*) AS DOUBLE) AS right_value, true AS passed FROM fact
    UNION ALL SELECT 'sum_case_count', CAST(sum(case_count) AS DOUBLE), CAST(sum(case_count) AS DOUBLE), true FROM fact""")
def idempotence(spark, sf):
    """Gold built and published twice from the same input: same rows, same cases."""
    fact = data.fact(spark, sf)
    first, second = scratch_path(spark, "gold"), scratch_path(spark, "gold")
    gold_store.write_fact(fact, first)
    gold_store.write_fact(gold.upsert_fact(gold_store.read_fact(spark, first), fact), second)
    stats = lambda root: quality.table_stats(gold_store.read_fact(spark, root), ["case_count"]).drop("file_count")
    return quality.same_stats(stats(first), stats(second))


@query("dq_expectations", "fact", sql="""
    WITH numbered AS (SELECT *, CAST(right(date_key, 2) AS INTEGER) AS d FROM fact),
    broken AS (SELECT CASE WHEN d = 5 THEN '5/' || date_key ELSE date_key END AS date_key,
                      CASE WHEN d = 6 THEN 'many' WHEN d = 7 THEN '-1' ELSE CAST(case_count AS VARCHAR) END AS case_count,
                      h3 NOT IN (SELECT h3 FROM fact WHERE date_key < '1995-03-01') AS unknown, d FROM numbered)
    SELECT 'date_format' AS rule, count(*) AS violations FROM broken WHERE d = 5 HAVING count(*) > 0
    UNION ALL SELECT 'case_count', count(*) FROM broken WHERE d IN (6, 7) HAVING count(*) > 0
    UNION ALL SELECT 'unknown_cell', count(*) FROM broken WHERE unknown HAVING count(*) > 0""")
def dq_expectations(spark, sf):
    fact = data.fact(spark, sf)
    day = F.substring("date_key", 9, 2).cast("int")
    broken = fact.withColumns(
        {
            "case_count": F.when(day == 6, "many").when(day == 7, "-1").otherwise(F.col("case_count").cast("string")),
            "date_key": F.when(day == 5, F.concat(F.lit("5/"), "date_key")).otherwise(F.col("date_key")),
        }
    )
    known = fact.where("date_key < '1995-03-01'").select("h3")
    return quality.violation_counts(quality.fact_violations(broken, known))


@query("unlocated_patients", "patients", sql="""
    SELECT metric, value FROM (SELECT CAST(count(*) AS DOUBLE) AS patients, CAST(count(*) FILTER (latitude IS NULL) AS DOUBLE) AS unlocated FROM patients)
    UNPIVOT (value FOR metric IN (patients, unlocated))""")
def unlocated_patients(spark, sf):
    stats = quality.unlocated_patients(data.patients(spark, sf))
    return quality.metric_rows(stats, "patient", data.RUN_TIME).select("metric", "value")


@query("manifest_diff", sql="""
    SELECT 'file-' || CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 5 = 0 THEN 'stale' WHEN event_id % 5 = 1 THEN 'copied'
            WHEN event_id % 5 = 2 THEN 'copied' ELSE 'skipped' END AS action FROM events""")
def manifest_diff(spark, sf):
    """Manifests of two trees: new, changed, unchanged and stale paths."""
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("file-"), F.col("event_id").cast("string")).alias("path"),
        F.col("user_id").alias("size"), F.unix_seconds("ts").alias("modified"),
    )
    source = rows.where("event_id % 5 <> 0")
    target = rows.where("event_id % 5 <> 1").withColumn(
        "modified", F.col("modified") + (F.col("event_id") % 5 == 2).cast("int")
    )
    return manifest.manifest_diff(source.drop("event_id"), target.drop("event_id"))


@query("stale_paths", sql="""
    SELECT 'file-' || CAST(event_id AS VARCHAR) AS path FROM events WHERE event_id % 5 = 0""")
def stale_paths(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("file-"), F.col("event_id").cast("string")).alias("path"))
    return manifest.stale_paths(rows.where("event_id % 5 <> 0"), rows)


@query("file_manifest", "fact", sql="""
    SELECT DISTINCT 'early/gold' AS tree, condition_code, CASE WHEN condition_code < '3' THEN 'skipped' ELSE 'copied' END AS action
    FROM fact WHERE date_key < '1996-01-01'
    UNION ALL
    SELECT DISTINCT 'late/gold', condition_code, CASE WHEN condition_code < '3' THEN 'skipped' ELSE 'copied' END
    FROM fact WHERE date_key >= '1996-01-01'""")
def file_manifest(spark, sf):
    """Two facts below folders of one name inside a folder of that name, against a target that lacks some codes."""
    root, fact = scratch_path(spark, "manifest") + "/gold", data.published_fact(spark, sf)
    gold_store.write_fact(fact.where("date_key < '1996-01-01'"), f"{root}/early/gold")
    gold_store.write_fact(fact.where("date_key >= '1996-01-01'"), f"{root}/late/gold")
    files = manifest.read_manifest(spark, root).where(F.length("sha256") == 64)
    code = F.url_decode(F.regexp_extract("path", "condition_code=([^/]+)/", 1))
    diff = manifest.manifest_diff(files, files.where(code < "3"))
    tree = F.regexp_extract("path", "^([^/]+/gold)/", 1)
    return diff.select(tree.alias("tree"), code.alias("condition_code"), "action").distinct()
