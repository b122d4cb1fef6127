"""Row numbers over groups of any size, and ordered top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegrid.operators.joins import join_groups
from casegrid.session import cut_lineage


def distributed_row_number(
    df: DataFrame, order: list[Column], groups: list[str] | None = None, name: str = "row_number"
) -> DataFrame:
    """Row number within each group (within the table without groups), starting at 1.

    A window would sort a whole group in one task. Here the rows are range-partitioned by group and
    order, numbered inside each slice, and shifted by the number of earlier rows of the group. The
    shift table has one row per slice and group. ``order`` must be total: equal rows cannot be split.

    Runs a job: the slices are written to the checkpoint folder, because a second evaluation of a
    range partitioning may cut differently.
    """
    groups = groups or []
    keys = [F.col(g) for g in groups]
    sliced = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy("_slice", *groups).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_slice", *groups, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = F.row_number().over(Window.partitionBy("_slice", *groups).orderBy(*order))
    numbered = sliced.withColumn("_inside", inside)
    on = [numbered["_slice"].eqNullSafe(shifts["_slice"])] + [numbered[g].eqNullSafe(shifts[g]) for g in groups]
    return numbered.join(shifts, on).select(
        *[numbered[c] for c in df.columns], (F.col("_inside") + F.col("_shift")).cast("bigint").alias(name)
    )


def position_ratio(
    df: DataFrame, order: list[Column], groups: list[str] | None = None, name: str = "ratio"
) -> DataFrame:
    """Position between 0 (first) and 1 (last) in the ordering; ties get their own positions."""
    groups = groups or []
    numbered = distributed_row_number(df, order, groups, "_position")
    if groups:
        sizes = df.groupBy(*groups).agg(F.count("*").alias("_n"))
        numbered, count = join_groups(numbered, sizes, groups), F.col("_n")
    else:
        count = df.agg(F.count("*")).scalar()
    ratio = (F.col("_position") - 1) / F.greatest(count - 1, F.lit(1))
    return numbered.withColumn(name, ratio).select(*df.columns, name)


def largest(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows; each task keeps only its own candidates."""
    return df.orderBy(*order).limit(limit)


def valid_cities(cities: DataFrame, min_population: int) -> DataFrame:
    """Anchor cities: readable numbers, coordinates in range, population at least the minimum."""
    number = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("0")).try_cast("double")
    return (
        cities.withColumns(
            {"lat": number("lat"), "lng": number("lng"), "population": F.floor(number("population"))}
        )
        .where(F.col("population") >= min_population)
        .where(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180))
    )


def top_cities(cities: DataFrame, max_cities: int, min_population: int) -> DataFrame:
    """The most populous valid cities, by name on a tie."""
    order = [F.col("population").desc(), F.col("city")]
    return largest(valid_cities(cities, min_population), order, max_cities)
