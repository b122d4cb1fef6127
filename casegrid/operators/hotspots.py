"""Window queries over the Gold fact."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from casegrid import schemas
from casegrid.functions import geo
from casegrid.functions.dates import clamp_window, normalize_date_key, shift_date_key
from casegrid.functions.text import json_string_array, with_default
from casegrid.operators.joins import join_groups

# Accepted spellings of each column, best first.
FACT_ALIASES = {
    "date_key": ["date_key", "date"],
    "h3": ["h3"],
    "case_count": ["case_count", "casecount"],
    "age_group": ["age_group", "agegroup"],
    "gender": ["gender"],
    "condition_code": ["condition_code", "condition"],
}
REQUIRED = ["date_key", "h3", "case_count"]
CONDITION_ALIASES = {
    "condition_code": ["condition_code", "condition"],
    "condition_display": ["condition_display", "display_name", "condition_code", "condition"],
    "patient_count": ["patient_count", "case_count"],
}
CELL_ALIASES = {"h3": ["h3", "h3_id"], "latitude": ["latitude", "lat"], "longitude": ["longitude", "lng", "lon"]}


@dataclass(frozen=True)
class Filters:
    """``condition_code=None`` asks for all conditions, each in its own window."""

    condition_code: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    age_groups: tuple[str, ...] = field(default_factory=lambda: tuple(schemas.AGE_GROUPS))
    genders: tuple[str, ...] = field(default_factory=lambda: tuple(schemas.GENDERS))


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate the table has, ignoring case."""
    by_lower = {name.lower(): name for name in reversed(df.columns)}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def canonical_fact(df: DataFrame) -> DataFrame:
    """Fact under the contract's names and types, whatever aliases it was written with."""
    columns = []
    for name, candidates in FACT_ALIASES.items():
        found = find_column(df, candidates)
        if found is not None:
            columns.append(F.col(found).cast("bigint" if name == "case_count" else "string").alias(name))
        elif name in REQUIRED:
            raise ValueError(f"no column {' or '.join(candidates)} in {df.columns}")
    return df.select(*columns)


def first_text(df: DataFrame, candidates: list[str]) -> Column:
    """First non-blank value of several optional columns, trimmed; '' when there is none."""
    values = [F.trim(F.col(c).cast("string")) for c in candidates if c in df.columns]
    return F.coalesce(*[F.when(F.length(v) > 0, v) for v in values], F.lit(""))


def first_number(df: DataFrame, candidates: list[str]) -> Column:
    """First value of several optional columns that reads as a finite number; 0 when there is none."""
    numbers = []
    for name in candidates:
        if name in df.columns:
            number = F.col(name).try_cast("double")
            numbers.append(F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number))
    return F.coalesce(*numbers, F.lit(0.0))


def conditions_metadata(df: DataFrame) -> DataFrame:
    """Condition options from a dimension written with any of the accepted names; blank codes drop."""
    return df.select(
        first_text(df, CONDITION_ALIASES["condition_code"]).alias("code"),
        first_text(df, CONDITION_ALIASES["condition_display"]).alias("display"),
        first_number(df, CONDITION_ALIASES["patient_count"]).cast("bigint").alias("patient_count"),
    ).where(F.length("code") > 0)


def cells_metadata(df: DataFrame) -> DataFrame:
    """Cell coordinates from a reference table written with any of the accepted names."""
    return df.select(
        first_text(df, CELL_ALIASES["h3"]).alias("h3"),
        first_number(df, CELL_ALIASES["latitude"]).alias("latitude"),
        first_number(df, CELL_ALIASES["longitude"]).alias("longitude"),
    ).where(F.length("h3") > 0)


def demographic_options(df: DataFrame) -> DataFrame:
    """Selectable age groups and genders of a condition dimension, with the standard defaults."""
    return df.select(
        "condition_code",
        with_default(json_string_array(F.col("age_groups_json")), schemas.AGE_GROUPS).alias("age_groups"),
        with_default(json_string_array(F.col("genders_json")), schemas.GENDERS).alias("genders"),
    )


def selection(fact: DataFrame, filters: Filters) -> Column:
    """Row predicate. Nothing selected in a demographic means no rows, not no filter."""
    if not filters.age_groups or not filters.genders:
        return F.lit(False)
    predicate = F.lit(True)
    if filters.start_date is not None:
        predicate = predicate & (F.col("date_key") >= filters.start_date)
    if filters.end_date is not None:
        predicate = predicate & (F.col("date_key") <= filters.end_date)
    if filters.condition_code is not None and "condition_code" in fact.columns:
        predicate = predicate & (F.col("condition_code") == filters.condition_code)
    for column, chosen in (("age_group", filters.age_groups), ("gender", filters.genders)):
        if column in fact.columns:
            predicate = predicate & F.col(column).isin(list(chosen))
    return predicate


def _by_condition(fact: DataFrame) -> list[str]:
    return ["condition_code"] if "condition_code" in fact.columns else []


def hotspots(fact: DataFrame, filters: Filters) -> DataFrame:
    """Per cell: cases, latest day and number of days; cells without cases drop."""
    # Days are counted after a per-day step, so no group has to hold its set of days.
    daily = daily_cells(fact, filters)
    return (
        daily.groupBy(*_by_condition(fact), "h3")
        .agg(
            F.sum("case_count").alias("case_count"),
            F.max("date_key").alias("latest_date"),
            F.count("*").alias("days_with_cases"),
        )
        .where("case_count > 0")
    )


def hotspot_stats(fact: DataFrame, filters: Filters) -> DataFrame:
    """Always one row: total cases and active days of the selection."""
    daily = fact.where(selection(fact, filters)).groupBy("date_key").agg(F.sum("case_count").alias("n"))
    return daily.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_cases"),
        F.count("date_key").alias("active_days"),
    )


def daily_cells(fact: DataFrame, filters: Filters) -> DataFrame:
    """Cases per day and cell, unordered and before the positive-count filter."""
    return (
        fact.where(selection(fact, filters))
        .groupBy(*_by_condition(fact), "date_key", "h3")
        .agg(F.sum("case_count").alias("case_count"))
    )


def daily_series(fact: DataFrame, filters: Filters) -> DataFrame:
    """Positive daily counts per cell in date order. The cell breaks ties, so a day with very many
    cells can still be split between sort partitions."""
    series = daily_cells(fact, filters).where("case_count > 0")
    return series.orderBy("date_key", *_by_condition(fact), "h3")


def latest_dates(fact: DataFrame) -> DataFrame:
    """Latest day per condition. The days are made distinct first: that is a hash aggregate, while
    the maximum of a text needs sorted input."""
    return fact.select("condition_code", "date_key").distinct().groupBy("condition_code").agg(F.max("date_key").alias("latest_date"))


def latest_date(fact: DataFrame, condition_code: str, today: dt.date) -> DataFrame:
    """One row: latest day of a condition, ``today`` when it has no data."""
    newest = F.max("date_key")
    return fact.where(F.col("condition_code") == condition_code).agg(
        F.coalesce(normalize_date_key(newest), F.lit(today.isoformat())).alias("latest_date")
    )


def window_rows(fact: DataFrame, days, condition_code: str | None, today: dt.date) -> DataFrame:
    """Rows of the ``days`` days that end at the latest day of the condition (of each condition).

    For one condition the anchor is a scalar subquery that reaches the Parquet scan as a filter. For
    all of them it is a table with a row per condition, which is computed and counted first (a job).
    """
    back = -(clamp_window(days) - 1)
    if condition_code is not None:
        anchor = latest_date(fact, condition_code, today)
        start = shift_date_key(anchor["latest_date"], back, today)
        bounds = (F.col("date_key") >= anchor.select(start).scalar()) & (F.col("date_key") <= anchor.scalar())
        return fact.where((F.col("condition_code") == condition_code) & bounds)
    anchors = latest_dates(fact).withColumn("start_date", shift_date_key(F.col("latest_date"), back, today))
    inside = F.col("date_key").between(F.col("start_date"), F.col("latest_date"))
    return join_groups(fact, anchors, ["condition_code"]).where(inside).drop("start_date", "latest_date")


def with_geography(points: DataFrame, cells: DataFrame, code: str = "h3") -> DataFrame:
    """Adds lat/lon: from the cell reference, else decoded from the cell id."""
    lat, lng = geo.cell_center(F.col(code))
    known = cells.select(F.col("h3").alias(code), "latitude", "longitude")
    return points.join(known, code, "left").select(
        *[points[c] for c in points.columns],
        F.coalesce("latitude", lat).alias("lat"),
        F.coalesce("longitude", lng).alias("lon"),
    )


def with_labels(points: DataFrame, conditions: DataFrame) -> DataFrame:
    """Adds the display label of the condition, the code itself when there is none."""
    labels = conditions.select("condition_code", "condition_display")
    return points.join(labels, "condition_code", "left").withColumn(
        "condition_display", F.coalesce("condition_display", "condition_code")
    )


def hotspot_points(
    fact: DataFrame,
    cells: DataFrame,
    conditions: DataFrame,
    days,
    today: dt.date,
    filters: Filters = Filters(),
) -> DataFrame:
    """The filtered hotspot query: window, aggregate, coordinates and label."""
    rows = window_rows(fact, days, filters.condition_code, today)
    return labelled_points(hotspots(rows, filters), cells, conditions)


def labelled_points(points: DataFrame, cells: DataFrame, conditions: DataFrame) -> DataFrame:
    """Hotspots with coordinates and label, as map points."""
    return with_labels(with_geography(points, cells), conditions).select(
        "condition_code", "condition_display", "h3", "lat", "lon",
        F.col("case_count").alias("cases"), F.col("case_count").alias("original_cases"),
        "latest_date", "days_with_cases",
    )


def overview(conditions: DataFrame, cells: DataFrame) -> DataFrame:
    """One row over both dimensions; stored totals are preferred to counted ones."""
    by_code = conditions.where(F.length("condition_code") > 0).agg(
        F.coalesce(F.nullif(F.max("total_unique").cast("bigint"), F.lit(0)), F.count("*")).alias("total_conditions"),
        F.coalesce(F.sum("patient_count"), F.lit(0)).cast("bigint").alias("total_cases"),
        F.max("generated_at").alias("generated_at"),
    )
    by_cell = cells.where(F.length("h3") > 0).agg(
        F.coalesce(F.nullif(F.max("total_unique").cast("bigint"), F.lit(0)), F.count("*")).alias("total_cells"),
        F.max("generated_at").alias("cells_generated_at"),
    )
    total_cells = by_cell.select("total_cells").scalar()
    cell_time = by_cell.select("cells_generated_at").scalar()
    return by_code.select(
        "total_conditions",
        "total_cases",
        F.col("total_cases").alias("total_patients"),
        total_cells.alias("total_cells"),
        F.coalesce("generated_at", cell_time).alias("generated_at"),
    )
