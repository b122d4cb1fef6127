"""CSV extracts -> FHIR transaction bundles."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from casegrid.functions.dates import parse_date, parse_timestamp
from casegrid.functions.text import blank_to_null, composite_id, mentions_any, stable_uuid
from casegrid.operators.ranking import distributed_row_number, largest
from casegrid.operators.remap import remap_time, with_time_range
from casegrid.session import scratch_path
from casegrid.sources import fhir

# The terms that select conditions by description.
TERMS = ["covid", "sars"]


@dataclass(frozen=True)
class Conversion:
    bundles: DataFrame
    selected: DataFrame
    dropped: DataFrame


def number_rows(rows: DataFrame) -> DataFrame:
    """Adds ``source_index``, the position of the row in its file set, starting at 1."""
    placed = rows.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_line": F.monotonically_increasing_id(),
        }
    )
    return distributed_row_number(
        placed, [F.col("_file"), F.col("_block"), F.col("_line")], name="source_index"
    ).drop("_file", "_block", "_line")


def select_conditions(conditions: DataFrame, terms: list[str] = TERMS, max_records: int | None = None) -> DataFrame:
    """Conditions whose description mentions a term and whose patient and encounter are given.

    ``max_records`` is the caller's cap on how much to convert, in file order.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = conditions.select(
        "source_index",
        parse_timestamp(F.col("START")).alias("start"),
        parse_timestamp(F.col("STOP")).alias("stop"),
        text("PATIENT").alias("patient_id"),
        text("ENCOUNTER").alias("encounter_id"),
        F.coalesce(blank_to_null(F.col("CODE")), F.lit(fhir.DEFAULT_CODE)).alias("code"),
        F.coalesce(blank_to_null(F.col("DESCRIPTION")), F.lit(fhir.DEFAULT_DISPLAY)).alias("description"),
    ).where(mentions_any(conditions["DESCRIPTION"], terms))
    rows = rows.where((F.length("patient_id") > 0) & (F.length("encounter_id") > 0))
    return rows if max_records is None else largest(rows, [F.col("source_index")], max_records)


def wanted(rows: DataFrame, id_column: str, selected: DataFrame, ref_column: str) -> DataFrame:
    """Parent rows some selected condition refers to."""
    keys = selected.select(F.col(ref_column).alias(id_column))
    return rows.withColumn(id_column, F.trim(id_column)).join(keys, id_column, "left_semi")


def with_parents(selected: DataFrame, patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Conditions whose patient and encounter both exist, with the parents' columns prefixed.

    Of several rows with one id the last of the file counts, where the parents are numbered
    (``source_index``, see :func:`number_rows`), and otherwise the one with the largest content.
    """
    p, e = _last(patients, "patient_id", "p_"), _last(encounters, "encounter_id", "e_")
    return selected.join(p, "patient_id").join(e, "encounter_id")


def _last(parents: DataFrame, key: str, prefix: str) -> DataFrame:
    """One row per id, found by an aggregate that combines before the shuffle."""
    columns = [c for c in parents.columns if c != "source_index"]
    order = [F.col("source_index")] if "source_index" in parents.columns else []
    last = F.max_by(F.struct(*columns), F.struct(*order, *columns)).alias("_row")
    rows = parents.groupBy(F.trim("Id").alias(key)).agg(last)
    return rows.select(key, *[F.col(f"_row.{c}").alias(f"{prefix}{c}") for c in columns])


def orphans(selected: DataFrame, patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Conditions that miss a parent."""
    p = patients.select(F.trim("Id").alias("patient_id"))
    e = encounters.select(F.trim("Id").alias("encounter_id"))
    no_patient = selected.join(p, "patient_id", "left_anti")
    no_encounter = selected.join(p, "patient_id", "left_semi").join(e, "encounter_id", "left_anti")
    return no_patient.unionByName(no_encounter.select(*no_patient.columns))


def bundle_columns(joined: DataFrame, target: tuple[dt.datetime, dt.datetime]) -> DataFrame:
    """One bundle per condition, its times moved linearly into the target range."""
    joined = with_time_range(joined, joined, "start")
    move = lambda c: remap_time(c, F.col("_range"), target)
    optional = lambda c: F.when(c.isNotNull(), move(c))
    key = composite_id(F.col("patient_id"), F.col("encounter_id"), F.col("source_index"))
    urn = {kind: F.concat(F.lit("urn:uuid:"), stable_uuid(F.lit(kind), key)) for kind in ("patient", "encounter", "condition")}
    encounter_start = parse_timestamp(F.col("e_START"))
    patient = fhir.patient_resource(
        F.col("patient_id"), F.col("p_FIRST"), F.col("p_LAST"), F.col("p_GENDER"), parse_date(F.col("p_BIRTHDATE")),
        F.col("p_ADDRESS"), F.col("p_CITY"), F.col("p_STATE"), F.col("p_ZIP"),
        F.col("p_LAT").try_cast("double"), F.col("p_LON").try_cast("double"),
    )
    encounter = fhir.encounter_resource(
        F.col("encounter_id"), urn["patient"], move(F.coalesce(encounter_start, F.col("start"))),
        optional(parse_timestamp(F.col("e_STOP"))), F.col("e_ENCOUNTERCLASS"), F.col("e_CODE"), F.col("e_DESCRIPTION"),
    )
    condition = fhir.condition_resource(
        key, urn["patient"], urn["encounter"], move(F.col("start")), optional(F.col("stop")),
        F.col("code"), F.col("description"),
    )
    bundle = fhir.transaction_bundle(
        fhir.bundle_entry(urn["patient"], patient, "PUT", fhir.upsert_url("Patient", F.col("patient_id"))),
        fhir.bundle_entry(urn["encounter"], encounter, "PUT", fhir.upsert_url("Encounter", F.col("encounter_id"))),
        fhir.bundle_entry(urn["condition"], condition, "POST", F.lit("Condition")),
    )
    return joined.select(key.alias("bundle_id"), "source_index", bundle.alias("bundle_json"))


def csv_to_fhir(
    conditions: DataFrame,
    patients: DataFrame,
    encounters: DataFrame,
    target: tuple[dt.datetime, dt.datetime],
    terms: list[str] = TERMS,
    max_records: int | None = None,
) -> Conversion:
    """Conditions need ``source_index`` (see :func:`number_rows`).

    The joined rows are written once, below the shared folder: the time range and the bundles read them.
    """
    selected = select_conditions(conditions, terms, max_records)
    patients = wanted(patients, "Id", selected, "patient_id")
    encounters = wanted(encounters, "Id", selected, "encounter_id")
    path = scratch_path(conditions.sparkSession, "csv-joined")
    with_parents(selected, patients, encounters).write.parquet(path)
    joined = conditions.sparkSession.read.parquet(path)
    return Conversion(bundle_columns(joined, target), selected, orphans(selected, patients, encounters))
