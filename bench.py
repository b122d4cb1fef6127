"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times (default 2) into a ``noop`` sink; the
median counts. ``value`` is the sum of the medians. With ``BENCH_COMPARE=1`` two comparison versions
written for this file run as well: the three derivations of the fact as row-at-a-time Python UDFs,
and the fact written by one job per condition.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import time

from pyspark.sql import DataFrame, functions as F

from casegrid.functions.dates import date_key
from casegrid.queries import QUERIES, data
from casegrid.schemas import GOLD_KEYS
from casegrid.session import local_session, scratch_path
from casegrid.sources import gold as gold_store

HEADLINE = [
    "gold_fact", "gold_fact_dense", "hotspots_window", "hotspots_one_condition", "daily_series",
    "cumulative_frames", "frame_stats", "silver_merge", "batch_dedupe", "gold_upsert", "gold_refresh",
    "fhir_patient_roundtrip", "fhir_observation_roundtrip", "fhir_medreq_roundtrip", "conditions_dim",
    "cells_dim", "overview", "hierarchical_allocation", "proportional_allocation", "near_pairs",
    "hotspot_components", "csv_to_fhir", "gold_sink",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, runs: int) -> float:
    action()
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def fact_with_python_udfs(spark, sf_dir: str) -> DataFrame:
    """The fact with age group, gender and cell derived row by row in Python, after the join."""
    as_of = data.AS_OF

    @F.udf("string")
    def age_group(dob):
        try:
            born = dt.date.fromisoformat(dob)
        except (TypeError, ValueError):
            return "Unknown"
        age = as_of.year - born.year - (as_of.timetuple()[1:3] < born.timetuple()[1:3])
        return next((name for top, name in ((17, "0-17"), (34, "18-34"), (54, "35-54"), (150, "55+")) if 0 <= age <= top), "Unknown")

    @F.udf("string")
    def gender(value):
        first = (value or "").strip().lower()
        return {"m": "male", "male": "male", "f": "female", "female": "female", "undifferentiated": "other"}.get(first, "unknown")

    @F.udf("string")
    def cell(lat, lng):
        return f"r4_{int((lat + 90) // 0.3515625)}_{int((lng + 180) // 0.3515625)}"

    rows = data.conditions(spark, sf_dir).join(data.patients(spark, sf_dir).where("latitude is not null"), "patient_id")
    derived = rows.select(
        "condition_code", date_key(F.col("condition_date")).alias("date_key"), cell("latitude", "longitude").alias("h3"),
        age_group("dob").alias("age_group"), gender("gender").alias("gender"), "city", "state",
    )
    return derived.groupBy(*GOLD_KEYS).agg(
        F.count("*").alias("case_count"), F.min("city").alias("city"), F.min("state").alias("state")
    )


def write_per_condition(fact: DataFrame, root: str) -> None:
    """One filtered job and one single-file write per condition."""
    for code in sorted(row[0] for row in fact.select("condition_code").distinct().collect()):
        fact.where(F.col("condition_code") == code).coalesce(1).write.parquet(f"{root}/{code.replace(' ', '_')}")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"), "casegrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {name: timed(lambda: run(QUERIES[name](spark, sf_dir)), runs) for name in names}
    result = {
        "metric": "casegrid_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs,
    }
    if os.environ.get("BENCH_COMPARE") == "1":
        fact = lambda: data.fact(spark, sf_dir)
        result["comparison"] = {
            "fact_python_udfs": timed(lambda: run(fact_with_python_udfs(spark, sf_dir)), runs),
            "write_one_job": timed(lambda: gold_store.write_fact(fact(), scratch_path(spark, "bench")), runs),
            "write_per_condition": timed(lambda: write_per_condition(fact(), scratch_path(spark, "bench")), runs),
        }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
