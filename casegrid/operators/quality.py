"""Table statistics, checks and data expectations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, functions as F

from casegrid.operators.dedupe import union_all


def table_stats(df: DataFrame, sum_columns: list[str]) -> DataFrame:
    """One row: files, rows and column sums of a file-backed table."""
    # Rows are counted per file first, so the file names are never gathered in one set.
    per_file = df.groupBy(F.input_file_name().alias("_file")).agg(
        F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sum_columns]
    )
    return per_file.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("row_count"),
        *[F.coalesce(F.sum(f"_sum_{c}"), F.lit(0)).cast("double").alias(f"sum_{c}") for c in sum_columns],
    )


def check_minimum(stats: DataFrame, column: str, minimum: int) -> DataFrame:
    """One row saying whether a statistic reaches its minimum."""
    return stats.select(
        F.lit(f"{column}_min").alias("check"),
        F.col(column).cast("bigint").alias("found"),
        F.lit(minimum).cast("bigint").alias("required"),
        (F.col(column) >= minimum).alias("passed"),
    )


def same_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per statistic: are two snapshots of :func:`table_stats` equal? (idempotence)"""
    columns = left.columns
    values = lambda df, name: df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in columns]))
    )
    return values(left, "left_value").join(values(right, "right_value"), "metric").withColumn(
        "passed", F.col("left_value").eqNullSafe(F.col("right_value"))
    )


def fact_violations(fact: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows that break the contract of the fact, with the rule they break.

    Rules: day as ``YYYY-MM-DD``, case count numeric and not negative, cell known to the reference.
    """
    count = F.col("case_count").try_cast("double")
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("date_key").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "date_format"),
            F.when(~F.coalesce(count >= 0, F.lit(False)), "case_count"),
            F.when(F.col("_known").isNull(), "unknown_cell"),
        )
    )
    known = cells.select("h3").distinct().withColumn("_known", F.lit(True))
    return fact.join(known, "h3", "left").withColumn("rule", F.explode(rules)).drop("_known")


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("violations"))


def metric_rows(stats: DataFrame, table_name: str, run_date: dt.datetime) -> DataFrame:
    """A one-row frame of statistics as rows of the data-quality log."""
    entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in stats.columns]
    return stats.select(
        F.lit(table_name).alias("table_name"),
        F.lit(run_date).cast("timestamp").alias("run_date"),
        F.inline(F.array(*entries)),
    )


def unlocated_patients(patients: DataFrame) -> DataFrame:
    """One row: patients whose missing coordinates keep their cases out of the fact."""
    return patients.agg(
        F.count("*").alias("patients"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("unlocated"),
    )


def keep_allowed(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(allowed))


def prune_report(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """One row: distinct values scanned, deleted and kept by an allow-list."""
    values = df.select(column).distinct()
    listed: Column = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return values.agg(
        F.count("*").alias("scanned"), F.count_if(~listed).alias("deleted"), F.count_if(listed).alias("kept")
    )


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """Counts that ride along with the next write instead of scanning the data again."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *metrics), observation


def combine_checks(*checks: DataFrame) -> DataFrame:
    return union_all(*checks)
