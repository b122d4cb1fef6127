"""Cumulative playback frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casegrid.functions.dates import date_key

_KEY = "condition_code"


def _carry_forward(states: DataFrame, keys: list[str], end: str) -> DataFrame:
    """Repeat each state daily until the day before the next one of its key, the last until ``end``.

    The states are exploded to the days they are valid on, so no join with a date axis is needed.
    """
    day = F.col("date_key").cast("date")
    following = F.lead("date_key").over(Window.partitionBy(*keys).orderBy("date_key"))
    until = F.coalesce(F.date_sub(following.cast("date"), 1), F.lit(end).cast("date"))
    return (
        states.withColumn("_until", until)
        .withColumn("_day", F.explode(F.sequence(day, F.col("_until"), F.expr("interval 1 day"))))
        .withColumn("frame_date", date_key(F.col("_day")))
        .drop("_until", "_day", "date_key")
    )


def cumulative_frames(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Per frame date every cell seen so far, with running cases, active days and latest day.

    ``daily`` has ``condition_code, date_key, h3, case_count``. Windows run over one cell's days, at
    most the length of the query window.
    """
    keys = [_KEY, "h3"]
    by_day = (
        daily.where(F.col("date_key").between(start, end))
        .groupBy(*keys, "date_key").agg(F.sum("case_count").alias("n")).where("n > 0")
    )
    so_far = Window.partitionBy(*keys).orderBy("date_key").rowsBetween(Window.unboundedPreceding, 0)
    states = by_day.select(
        *keys,
        "date_key",
        F.sum("n").over(so_far).alias("cases"),
        F.count("*").over(so_far).alias("days_with_cases"),
        F.col("date_key").alias("latest_date"),
    )
    return _carry_forward(states, keys, end).select(
        _KEY, "frame_date", "h3", "cases", F.col("cases").alias("original_cases"), "days_with_cases", "latest_date"
    )


def date_axis(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Every day of the window for every condition."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return daily.select(_KEY).distinct().select(_KEY, F.explode(days).alias("d")).select(
        _KEY, date_key(F.col("d")).alias("frame_date")
    )


def frame_stats(daily: DataFrame, start: str, end: str) -> DataFrame:
    """Cases, cells and running active days of every frame, quiet days before the first case included.

    Works on increments: a day's new cases and newly seen cells are summed up once, so the dense
    frames are not built for it. The running sums go over one row per day.
    """
    inside = daily.where(F.col("date_key").between(start, end) & (F.col("case_count") > 0))
    per_cell = inside.groupBy(_KEY, "h3", "date_key").agg(F.sum("case_count").alias("n"))
    first_seen = per_cell.groupBy(_KEY, "h3").agg(F.min("date_key").alias("date_key"))
    new_cells = first_seen.groupBy(_KEY, "date_key").agg(F.count("*").alias("new_cells"))
    new_cases = per_cell.groupBy(_KEY, "date_key").agg(F.sum("n").alias("new_cases"))
    increments = new_cases.join(new_cells, [_KEY, "date_key"], "left").withColumnRenamed("date_key", "frame_date")
    so_far = Window.partitionBy(_KEY).orderBy("frame_date").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0).cast("bigint"))
    active = F.sum(F.when(F.col("new_cases") > 0, 1).otherwise(0)).over(so_far)
    return (
        date_axis(daily, start, end)
        .join(increments, [_KEY, "frame_date"], "left")
        .select(
            _KEY, "frame_date",
            running("new_cases").alias("total_cases"),
            running("new_cells").alias("cell_count"),
            active.alias("active_days"),
        )
    )
