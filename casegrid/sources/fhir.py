"""FHIR resources as JSON text: typed extraction, construction and bundle pages.

Extraction parses each resource once with ``from_json`` and the schema of the fields that are kept;
everything else in the resource is skipped by the parser.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegrid.functions.dates import iso_utc, parse_timestamp
from casegrid.functions.text import blank_to_null, canonical_reference, first_present, person_name

_META = "meta struct<lastUpdated:string>"
_REF = "struct<reference:string>"
_CONCEPT = "struct<coding:array<struct<code:string,display:string>>,text:string>"

PAYLOADS = {
    "patient": (
        "id string, name array<struct<text:string,given:array<string>,family:string>>, birthDate string,"
        " gender string, telecom array<struct<value:string>>,"
        " address array<struct<city:string,state:string,postalCode:string,country:string>>, " + _META
    ),
    "encounter": (
        f"id string, subject {_REF}, period struct<start:string>,"
        f" participant array<struct<individual:{_REF}>>, reasonCode array<{_CONCEPT}>, {_META}"
    ),
    "observation": (
        f"id string, subject {_REF}, encounter {_REF}, code {_CONCEPT},"
        f" valueQuantity struct<value:string,unit:string>, issued string, {_META}"
    ),
    "condition": (
        f"id string, subject {_REF}, encounter {_REF}, code {_CONCEPT}, clinicalStatus {_CONCEPT},"
        f" verificationStatus {_CONCEPT}, recordedDate string, {_META}"
    ),
    "medicationrequest": (
        f"id string, subject {_REF}, encounter {_REF}, medicationCodeableConcept {_CONCEPT},"
        f" status string, intent string, authoredOn string, {_META}"
    ),
}

# Fixed value: where a coordinate sits in the text of a geolocation extension.
GEO_PATTERN = r'"url"\s*:\s*"{axis}"\s*,\s*"valueDecimal"\s*:\s*(-?\d+(?:\.\d+)?{exponent})'


def geo_coordinate(resource_json: Column, axis: str, parity: bool = False) -> Column:
    """``latitude`` or ``longitude`` of the geolocation extension, wherever it is in the document.

    ``parity=True`` drops an exponent from the number (``1e-5`` -> ``1``).
    """
    exponent = "" if parity else r"(?:[eE][+-]?\d+)?"
    pattern = GEO_PATTERN.replace("{axis}", axis).replace("{exponent}", exponent)
    return F.regexp_extract(resource_json, pattern, 1).try_cast("double")


def _parsed(bronze: DataFrame, table: str) -> DataFrame:
    return bronze.withColumn("r", F.from_json("resource_json", PAYLOADS[table]))


def _head(items: Column) -> Column:
    """First array element, NULL when the array is missing or empty (ANSI indexing would raise)."""
    return F.get(items, 0)


def _coding(concept: Column, field: str) -> Column:
    return _head(concept["coding"])[field]


def _concept_text(concept: Column) -> Column:
    return first_present(_coding(concept, "display"), concept["text"])


def _reference(name: str) -> Column:
    return canonical_reference(F.col(f"r.{name}.reference"))


def _audit(run_time: dt.datetime) -> list[Column]:
    return [
        F.col("ingestion_timestamp").alias("created_at"),
        F.lit(run_time).cast("timestamp").alias("updated_at"),
        parse_timestamp(F.col("r.meta.lastUpdated")).alias("source_updated_at"),
    ]


def extract_patients(bronze: DataFrame, run_time: dt.datetime, parity: bool = False) -> DataFrame:
    name, address = _head(F.col("r.name")), _head(F.col("r.address"))
    return _parsed(bronze, "patient").select(
        canonical_reference(F.col("r.id")).alias("patient_id"),
        person_name(name["text"], _head(name["given"]), name["family"]).alias("name"),
        F.col("r.birthDate").alias("dob"),
        F.col("r.gender").alias("gender"),
        address["city"].alias("city"),
        address["state"].alias("state"),
        address["postalCode"].alias("zipcode"),
        address["country"].alias("country"),
        geo_coordinate(F.col("resource_json"), "latitude", parity).alias("latitude"),
        geo_coordinate(F.col("resource_json"), "longitude", parity).alias("longitude"),
        _head(F.col("r.telecom"))["value"].alias("phone"),
        *_audit(run_time),
    )


def extract_encounters(bronze: DataFrame, run_time: dt.datetime) -> DataFrame:
    return _parsed(bronze, "encounter").select(
        canonical_reference(F.col("r.id")).alias("encounter_id"),
        _reference("subject").alias("patient_id"),
        parse_timestamp(F.col("r.period.start")).alias("encounter_date"),
        canonical_reference(_head(F.col("r.participant"))["individual"]["reference"]).alias("provider_id"),
        _concept_text(_head(F.col("r.reasonCode"))).alias("diagnosis"),
        *_audit(run_time),
    )


def extract_observations(bronze: DataFrame, run_time: dt.datetime) -> DataFrame:
    value = F.col("r.valueQuantity.value")
    return _parsed(bronze, "observation").select(
        canonical_reference(F.col("r.id")).alias("obs_id"),
        _reference("subject").alias("patient_id"),
        _reference("encounter").alias("encounter_id"),
        _coding(F.col("r.code"), "code").alias("observation_code"),
        _concept_text(F.col("r.code")).alias("observation_text"),
        value.alias("value"),
        value.try_cast("double").alias("value_num"),
        F.col("r.valueQuantity.unit").alias("unit"),
        parse_timestamp(F.col("r.issued")).alias("observation_time"),
        *_audit(run_time),
    )


def extract_conditions(bronze: DataFrame, run_time: dt.datetime) -> DataFrame:
    return _parsed(bronze, "condition").select(
        canonical_reference(F.col("r.id")).alias("condition_id"),
        _reference("subject").alias("patient_id"),
        _reference("encounter").alias("encounter_id"),
        _coding(F.col("r.code"), "code").alias("condition_code"),
        _concept_text(F.col("r.code")).alias("condition_text"),
        _coding(F.col("r.clinicalStatus"), "code").alias("clinical_status"),
        _coding(F.col("r.verificationStatus"), "code").alias("verification_status"),
        parse_timestamp(F.col("r.recordedDate")).alias("condition_date"),
        *_audit(run_time),
    )


def extract_medication_requests(bronze: DataFrame, run_time: dt.datetime) -> DataFrame:
    concept = F.col("r.medicationCodeableConcept")
    return _parsed(bronze, "medicationrequest").select(
        canonical_reference(F.col("r.id")).alias("medicationrequest_id"),
        _reference("subject").alias("patient_id"),
        _reference("encounter").alias("encounter_id"),
        _coding(concept, "code").alias("medication_code"),
        _concept_text(concept).alias("medication_text"),
        F.col("r.status").alias("status"),
        F.col("r.intent").alias("intent"),
        parse_timestamp(F.col("r.authoredOn")).alias("authored_on"),
        *_audit(run_time),
    )


# resource type -> (Silver table, key column, extraction)
RESOURCES = {
    "Patient": ("patient", "patient_id", extract_patients),
    "Encounter": ("encounter", "encounter_id", extract_encounters),
    "Observation": ("observation", "obs_id", extract_observations),
    "Condition": ("condition", "condition_id", extract_conditions),
    "MedicationRequest": ("medicationrequest", "medicationrequest_id", extract_medication_requests),
}


# --- construction -------------------------------------------------------------------------------

# Systems and URLs of the built resources.
GEO_URL = "http://hl7.org/fhir/StructureDefinition/geolocation"
CLINICAL_SYSTEM = "http://terminology.hl7.org/CodeSystem/condition-clinical"
VERIFICATION_SYSTEM = "http://terminology.hl7.org/CodeSystem/condition-ver-status"
ENCOUNTER_CLASS_SYSTEM = "http://terminology.hl7.org/CodeSystem/v3-ActCode"
PROCEDURE_SYSTEM = "http://www.ama-assn.org/go/cpt"
SNOMED_SYSTEM = "http://snomed.info/sct"
IDENTIFIER_SYSTEM = "urn:casegrid:{kind}"
DEFAULT_CODE = "840539006"
DEFAULT_DISPLAY = "COVID-19"


def _obj(**fields: Column | str) -> Column:
    """A JSON object as a struct; ``to_json`` leaves out the fields that are NULL."""
    return F.struct(
        *[(F.lit(v) if isinstance(v, str) else v).alias(name.rstrip("_")) for name, v in fields.items()]
    )


def _identifier(kind: str, value: Column) -> Column:
    return F.array(_obj(system=IDENTIFIER_SYSTEM.format(kind=kind), value=value))


def _coded(system: str, code: Column | str, display: Column | None = None) -> Column:
    fields = {"system": system, "code": code}
    if display is not None:
        fields["display"] = display
    return F.array(_obj(**fields))


def patient_resource(
    id_: Column, first: Column, last: Column, gender: Column, born: Column, address: Column,
    city: Column, state: Column, zipcode: Column, lat: Column, lng: Column, resource_id: Column | None = None,
) -> Column:
    """Patient struct. Birth date and coordinates are left out when unknown."""
    first, last = blank_to_null(first), blank_to_null(last)
    lowered = F.lower(F.trim(gender))
    known = F.when(lowered.isin("male", "female", "other"), lowered).otherwise("unknown")
    axes = F.array(_obj(url="latitude", valueDecimal=lat), _obj(url="longitude", valueDecimal=lng))
    location = F.when(lat.isNotNull() & lng.isNotNull(), F.array(_obj(url=GEO_URL, extension=axes)))
    full_name = F.concat_ws(" ", first, last)
    text = F.when(F.length(full_name) > 0, full_name).otherwise(id_)
    empty = lambda c: F.coalesce(c, F.lit(""))
    fields = dict(
        resourceType="Patient",
        identifier=_identifier("patient", id_),
        name=F.array(_obj(given=F.array_compact(F.array(first)), family=empty(last), text=text)),
        gender=known,
        birthDate=F.date_format(born, "yyyy-MM-dd"),
        address=F.array(
            _obj(
                line=F.array(empty(address)), city=empty(city), state=empty(state),
                postalCode=empty(zipcode), country="US", extension=location,
            )
        ),
    )
    if resource_id is not None:
        fields["id"] = resource_id
    return _obj(**fields)


def _end_of(start: Column, stop: Column) -> Column:
    return F.when(stop >= start, iso_utc(stop))


def encounter_resource(
    id_: Column, patient_ref: Column, start: Column, stop: Column, class_: Column, code: Column,
    description: Column, resource_id: Column | None = None,
) -> Column:
    """Encounter struct; coding and end are left out when absent."""
    label = F.coalesce(blank_to_null(description), F.lit("Encounter"))
    code = blank_to_null(code)
    fields = dict(
        resourceType="Encounter",
        identifier=_identifier("encounter", id_),
        status="finished",
        class_=_obj(
            system=ENCOUNTER_CLASS_SYSTEM, code=F.coalesce(F.upper(blank_to_null(class_)), F.lit("AMB"))
        ),
        subject=_obj(reference=patient_ref),
        period=_obj(start=iso_utc(start), end=_end_of(start, stop)),
        type=F.array(
            _obj(text=label, coding=F.when(code.isNotNull(), _coded(PROCEDURE_SYSTEM, code, label)))
        ),
    )
    if resource_id is not None:
        fields["id"] = resource_id
    return _obj(**fields)


def condition_resource(
    id_: Column, patient_ref: Column, encounter_ref: Column, start: Column, stop: Column, code: Column,
    description: Column, resource_id: Column | None = None,
) -> Column:
    """Active, confirmed Condition struct; abatement is left out when absent or before the start."""
    code = F.coalesce(blank_to_null(code), F.lit(DEFAULT_CODE))
    label = F.coalesce(blank_to_null(description), F.lit(DEFAULT_DISPLAY))
    fields = dict(
        resourceType="Condition",
        identifier=_identifier("condition", id_),
        clinicalStatus=_obj(coding=_coded(CLINICAL_SYSTEM, "active")),
        verificationStatus=_obj(coding=_coded(VERIFICATION_SYSTEM, "confirmed")),
        code=_obj(coding=_coded(SNOMED_SYSTEM, code, label), text=label),
        subject=_obj(reference=patient_ref),
        encounter=_obj(reference=encounter_ref),
        recordedDate=iso_utc(start),
        onsetDateTime=iso_utc(start),
        abatementDateTime=_end_of(start, stop),
    )
    if resource_id is not None:
        fields["id"] = resource_id
    return _obj(**fields)


def upsert_url(kind: str, value: Column) -> Column:
    """Conditional-update URL by business identifier."""
    return F.concat(F.lit(f"{kind}?identifier={IDENTIFIER_SYSTEM.format(kind=kind.lower())}|"), value)


def bundle_entry(full_url: Column, resource: Column, method: str, url: Column | str) -> Column:
    """One entry as JSON text. Entries hold differently shaped resources, so they are joined as text."""
    return F.to_json(_obj(fullUrl=full_url, resource=resource, request=_obj(method=method, url=url)))


def transaction_bundle(*entries: Column) -> Column:
    """Transaction bundle JSON of the given entries."""
    return F.concat(
        F.lit('{"resourceType":"Bundle","type":"transaction","entry":['),
        F.concat_ws(",", *entries),
        F.lit("]}"),
    )


# --- searchset pages ------------------------------------------------------------------------------


# Between pages of one file: the record separator of JSON text sequences (RFC 7464), which no JSON text
# holds unescaped.
PAGE_END = "\x1e"


def read_bundle_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed searchset pages, one per row: a file is a page, or several with ``PAGE_END`` after each.

    A page holds at most a few hundred resources; it may have line breaks.
    """
    return spark.read.text(path, lineSep=PAGE_END).withColumnRenamed("value", "bundle_json")


def write_bundle_pages(pages: DataFrame, path: str) -> None:
    """Land the column ``bundle_json``, many pages to a file.

    A folder or file of its own for every page is created, listed and opened on its own, which takes
    longer than its few kilobytes.
    """
    pages.select("bundle_json").write.text(path, compression="gzip", lineSep=PAGE_END)


def explode_bundles(pages: DataFrame, column: str = "bundle_json") -> DataFrame:
    """One row per resource of each page; entries without a resource are skipped.

    The ``string`` field keeps the raw JSON of the resource.
    """
    envelope = F.from_json(column, "entry array<struct<resource:string>>")["entry"]
    others = [c for c in pages.columns if c != column]
    entries = pages.select(*others, F.explode(envelope).alias("e"))
    head = F.from_json("resource_json", "id string, resourceType string")
    return (
        entries.select(*others, F.col("e.resource").alias("resource_json"))
        .where(F.col("resource_json").isNotNull())
        .withColumn("h", head)
        .select(
            *others,
            F.col("h.id").alias("resource_id"),
            F.coalesce("h.resourceType", F.lit("Unknown")).alias("resource_type"),
            "resource_json",
        )
    )


def latest_source_time(resources: DataFrame, fallback: dt.datetime | None) -> DataFrame:
    """One row: the newest ``meta.lastUpdated``, never older than the fallback cursor."""
    stamp = parse_timestamp(F.from_json("resource_json", _META)["meta"]["lastUpdated"])
    newest = F.max(stamp)
    return resources.agg(F.greatest(newest, F.lit(fallback).cast("timestamp")).alias("latest"))
