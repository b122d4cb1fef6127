"""Physical plans: pushdown, pruning, early elimination of losers, no cross joins, no Python rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casegrid import session
from casegrid.operators import dedupe, gold, merge
from casegrid.queries import QUERIES, data
from casegrid.sources import bronze, fhir
from casegrid.sources import gold as gold_store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def _settings(spark):
    session.apply_settings(spark)


def test_losers_are_dropped_before_the_shuffle(spark):
    rows = data.table(spark, SF, "events").withColumnRenamed("user_id", "patient_id")
    text = plan(dedupe.latest_per_key(rows, "patient_id", [F.col("ts").desc()]))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_fact_reads_and_shuffles_few_columns(spark):
    text = plan(data.fact(spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert "hashpartitioning(condition_code" in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert "PushedFilters: [IsNotNull(o_orderdate), IsNotNull(o_orderpriority)]" in text


def test_bronze_scan_prunes_partitions_and_pushes_the_cursor(spark):
    root = session.scratch_path(spark, "plan")
    df = spark.createDataFrame([("1", "Patient", "{}")], "resource_id string, resource_type string, resource_json string")
    bronze.write_bronze(bronze.bronze_rows(df, data.RUN_1, data.RUN_TIME), root)
    text = plan(bronze.read_bronze(spark, root, "Patient", data.RUN_1, since=dt.datetime(2024, 1, 1)))
    assert "PartitionFilters: [isnotnull(resource_type" in text and "GreaterThan(ingestion_timestamp" in text


def test_condition_scan_reads_one_partition(spark):
    root = session.scratch_path(spark, "plan")
    gold_store.write_fact(data.fact(spark, SF), root)
    text = plan(gold_store.read_fact(spark, root, "1-URGENT").where("date_key >= '1999-01-01'").select("h3"))
    assert "PartitionFilters: [isnotnull(condition_code" in text and "GreaterThanOrEqual(date_key" in text
    assert "ReadSchema: struct<date_key:string,h3:string>" in text


def test_resource_is_parsed_once(spark):
    root = session.scratch_path(spark, "plan")
    data.condition_bronze(spark, SF).write.parquet(root)
    text = plan(fhir.extract_conditions(spark.read.parquet(root), data.RUN_TIME))
    assert text.count("from_json(") == 1


def test_upsert_needs_no_window(spark):
    fact = data.fact(spark, SF)
    text = plan(gold.upsert_fact(fact, fact.where("date_key > '2001-01-01'")))
    assert "LeftAnti" in text and "Window" not in text


def test_distance_join_is_an_equi_join(spark):
    text = plan(merge.near_pairs(data.world_points(spark, SF), 2))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["cumulative_frames", "frame_stats", "daily_series", "conditions_dim", "time_remap", "overview"])
def test_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
