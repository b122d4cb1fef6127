"""Explicit schemas of every table the jobs read or write.

Readers always pass one of these: partition-type inference would otherwise turn all-digit run ids
and numeric-looking condition codes into numbers.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


# Landed raw resources. resource_type, ingestion_date and run_ts are the partition columns.
BRONZE = _struct(
    resource_id=S,
    ingestion_timestamp=TS,
    resource_json=S,
    resource_type=S,
    ingestion_date=S,
    run_ts=S,
)
BRONZE_PARTITIONS = ["resource_type", "ingestion_date", "run_ts"]

_AUDIT = dict(created_at=TS, updated_at=TS, source_updated_at=TS)

PATIENT = _struct(
    patient_id=S, name=S, dob=S, gender=S, city=S, state=S, zipcode=S, country=S,
    latitude=D, longitude=D, phone=S, **_AUDIT,
)
ENCOUNTER = _struct(
    encounter_id=S, patient_id=S, encounter_date=TS, provider_id=S, diagnosis=S, **_AUDIT,
)
OBSERVATION = _struct(
    obs_id=S, patient_id=S, encounter_id=S, observation_code=S, observation_text=S,
    value=S, value_num=D, unit=S, observation_time=TS, **_AUDIT,
)
CONDITION = _struct(
    condition_id=S, patient_id=S, encounter_id=S, condition_code=S, condition_text=S,
    clinical_status=S, verification_status=S, condition_date=TS, **_AUDIT,
)
MEDICATION_REQUEST = _struct(
    medicationrequest_id=S, patient_id=S, encounter_id=S, medication_code=S, medication_text=S,
    status=S, intent=S, authored_on=TS, **_AUDIT,
)

SILVER = {
    "patient": PATIENT,
    "encounter": ENCOUNTER,
    "observation": OBSERVATION,
    "condition": CONDITION,
    "medicationrequest": MEDICATION_REQUEST,
}

GOLD_KEYS = ["condition_code", "date_key", "h3", "age_group", "gender"]
GOLD_FACT = _struct(
    condition_code=S, date_key=S, h3=S, age_group=S, gender=S, case_count=L, city=S, state=S,
)
CONDITIONS_DIM = _struct(
    condition_code=S, condition_display=S, patient_count=L, generated_at=S, total_unique=I,
    age_groups_json=S, genders_json=S,
)
CELLS_DIM = _struct(h3=S, latitude=D, longitude=D, generated_at=S, total_unique=I)
# Kept with the dimensions, so that a change of some conditions needs no look at the others.
CONDITION_CELLS = _struct(condition_code=S, h3=S, case_count=L)
CONDITION_TEXTS = _struct(condition_code=S, condition_text=S, n=L)

# Append-only run-state logs; the current value is the newest row per id.
CURSOR_LOG = _struct(id=S, last_cursor=TS, last_update=TS)
RUN_STATE_LOG = _struct(id=S, run_ts=S, details=S, last_update=TS)
JOB_LOG = _struct(
    job_name=S, status=S, records_processed=L, started_at=TS, error_message=S, created_at=TS,
    pipeline_run_id=S, details=S,
)
RUN_SUMMARY_LOG = _struct(
    id=S, status=S, run_ts=S, started_at=TS, completed_at=TS, error=S, last_update=TS,
)
QUALITY_LOG = _struct(table_name=S, run_date=TS, metric=S, value=D)

# The demographic domains of the Gold contract.
AGE_GROUPS = ["0-17", "18-34", "35-54", "55+", "Unknown"]
GENDERS = ["male", "female", "other", "unknown"]
