"""Linear time remapping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def time_range(df: DataFrame, column: str) -> DataFrame:
    """One row: first and last timestamp."""
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def remap_time(value: Column, bounds: Column, target: tuple[dt.datetime, dt.datetime]) -> Column:
    """Move a timestamp from the range ``bounds(first, last)`` to the target range, clamped at both ends.

    NULL and an empty source range go to the end of the target.
    """
    first, last = F.unix_micros(bounds["first"]), F.unix_micros(bounds["last"])
    low, high = (int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000) for t in target)
    position = (F.unix_micros(value) - first) / (last - first).cast("double")
    offset = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), position)) * (high - low)).cast("bigint")
    usable = value.isNotNull() & (last > first) & F.lit(high > low)
    return F.timestamp_micros(F.when(usable, F.lit(low) + offset).otherwise(F.lit(high)))


def with_time_range(df: DataFrame, source: DataFrame, column: str, name: str = "_range") -> DataFrame:
    """``df`` with the time range of ``source`` in every row, computed once as a scalar subquery."""
    return df.withColumn(name, time_range(source, column).select(F.struct("first", "last")).scalar())
