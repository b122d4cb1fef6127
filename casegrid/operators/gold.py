"""The Gold fact and its dimensions."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, functions as F

from casegrid import schemas
from casegrid.functions import geo
from casegrid.functions.dates import date_key
from casegrid.functions.demographics import (
    age_band, age_years, band_label, birth_date, gender_code, gender_label,
)
from casegrid.operators.dedupe import add_missing, conform, upsert
from casegrid.session import cut_lineage

# Grouping keys while rows are shuffled: fixed-width codes instead of the texts of the contract.
CODED_KEYS = ["condition_code", "day", "cell", "age", "sex"]


def located_patients(
    patients: DataFrame, as_of: dt.date, resolution: int = geo.DEFAULT_RESOLUTION, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Patients with a valid cell, with everything the fact needs (and ``extra`` columns) derived once per patient."""
    lat, lng = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    return patients.select(
        "patient_id",
        geo.cell_key(lat, lng, resolution).alias("cell"),
        age_band(age_years(birth_date(F.col("dob")), as_of)).alias("age"),
        gender_code(F.col("gender")).alias("sex"),
        "city",
        "state",
        *extra,
    ).where(F.col("cell").isNotNull())


def dated_conditions(conditions: DataFrame) -> DataFrame:
    """Conditions with a code and a date."""
    return conditions.select(
        "patient_id",
        "condition_code",
        F.col("condition_date").cast("date").alias("day"),
    ).where(F.col("condition_code").isNotNull() & F.col("day").isNotNull())


def demographic_join(conditions: DataFrame, patients: DataFrame) -> DataFrame:
    """Conditions with their patient's demographics.

    Three narrow columns of the large side are shuffled. No hint: AQE broadcasts the patients when
    they are measured to be small, and splits the partition of a patient with very many conditions.
    """
    return conditions.join(patients, on="patient_id", how="inner")


def labelled_keys(resolution: int = geo.DEFAULT_RESOLUTION) -> list[Column]:
    """The keys of the contract from the coded ones."""
    return [
        F.col("condition_code"),
        date_key(F.col("day")).alias("date_key"),
        geo.cell_name(F.col("cell"), resolution).alias("h3"),
        band_label(F.col("age")).alias("age_group"),
        gender_label(F.col("sex")).alias("gender"),
    ]


def count_cases(joined: DataFrame, resolution: int = geo.DEFAULT_RESOLUTION) -> DataFrame:
    """Cases per fact key. ``min`` makes the representative place repeatable; all three aggregates
    combine before the shuffle, so one dominant key costs one row per map task."""
    counted = joined.groupBy(*CODED_KEYS).agg(
        F.count("*").alias("case_count"),
        F.min("city").alias("city"),
        F.min("state").alias("state"),
    )
    return counted.select(*labelled_keys(resolution), "case_count", "city", "state")


def gold_fact(
    conditions: DataFrame, patients: DataFrame, as_of: dt.date, resolution: int = geo.DEFAULT_RESOLUTION
) -> DataFrame:
    """Cases by condition, day, cell, age group and gender."""
    located = located_patients(patients, as_of, resolution)
    return count_cases(demographic_join(dated_conditions(conditions), located), resolution)


def upsert_fact(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Reference-compatible upsert: a new count replaces the old one, vanished keys stay."""
    if existing is None:
        return conform(new, schemas.GOLD_FACT)
    return upsert(conform(existing, schemas.GOLD_FACT), conform(new, schemas.GOLD_FACT), schemas.GOLD_KEYS)


def _json_list(values: list[str]) -> Column:
    return F.lit(json.dumps(values))


def case_totals(fact: DataFrame) -> DataFrame:
    """Total cases per condition under the contract's name ``patient_count``."""
    return fact.groupBy("condition_code").agg(F.sum("case_count").alias("patient_count"))


def true_patient_counts(conditions: DataFrame, patients: DataFrame, as_of: dt.date) -> DataFrame:
    """Distinct patients per condition, which the contract's ``patient_count`` is not."""
    pairs = demographic_join(dated_conditions(conditions), located_patients(patients, as_of))
    # Two steps on purpose: the pair shuffle spreads a dominant condition over all reducers.
    return (
        pairs.select("condition_code", "patient_id").distinct()
        .groupBy("condition_code").agg(F.count("*").alias("true_patient_count"))
    )


def condition_cells(fact: DataFrame) -> DataFrame:
    """Cases per condition and cell: a bounded table from which both dimensions follow."""
    return fact.groupBy("condition_code", "h3").agg(F.sum("case_count").alias("case_count"))


def condition_texts(conditions: DataFrame) -> DataFrame:
    """How often each condition comes with each text; signed rows count with their sign."""
    count = F.sum("sign") if "sign" in conditions.columns else F.count("*")
    return (
        conditions.where(F.col("condition_code").isNotNull() & (F.length("condition_text") > 0))
        .groupBy("condition_code", "condition_text").agg(count.alias("n"))
    )


def labels_of(texts: DataFrame) -> DataFrame:
    """Most frequent text per code, first in alphabetical order on a tie."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("condition_text").alias("text")))
    return texts.groupBy("condition_code").agg(best["text"].alias("condition_display"))


def condition_labels(conditions: DataFrame) -> DataFrame:
    """Most frequent text per code, first in alphabetical order on a tie."""
    return labels_of(condition_texts(conditions))


def conditions_dim(
    fact: DataFrame,
    generated_at: str,
    labels: DataFrame | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """One row per condition. Conditions only the existing dimension knows are kept.

    The totals are checkpointed, a row per condition, so that the fact is read once. Runs a job.
    """
    totals = case_totals(fact)
    if labels is None:
        named = totals.withColumn("condition_display", F.col("condition_code"))
    else:
        named = totals.join(labels, "condition_code", "left").withColumn(
            "condition_display", F.coalesce("condition_display", "condition_code")
        )
    if existing is not None:
        known = existing.where(F.length("condition_code") > 0).select(*named.columns)
        named = upsert(known, named, ["condition_code"])
    named = cut_lineage(named)
    return conform(
        named.withColumns(
            {
                "generated_at": F.lit(generated_at),
                "total_unique": F.lit(named.count()),
                "age_groups_json": _json_list(schemas.AGE_GROUPS),
                "genders_json": _json_list(schemas.GENDERS),
            }
        ),
        schemas.CONDITIONS_DIM,
    )


def cells_dim(fact: DataFrame, generated_at: str, existing: DataFrame | None = None) -> DataFrame:
    """One row per cell with its centre. Cells already known keep their coordinates.

    The cells, a bounded number, are checkpointed, so that the fact is read once. Runs a job.
    """
    lat, lng = geo.cell_center(F.col("h3"))
    cells = fact.where(F.length("h3") > 0).select("h3").distinct().select(
        "h3", lat.alias("latitude"), lng.alias("longitude")
    )
    if existing is not None:
        cells = add_missing(
            existing.where(F.length("h3") > 0).select("h3", "latitude", "longitude"), cells, ["h3"]
        )
    cells = cut_lineage(cells)
    return conform(
        cells.withColumns({"generated_at": F.lit(generated_at), "total_unique": F.lit(cells.count())}),
        schemas.CELLS_DIM,
    )
