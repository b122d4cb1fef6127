"""Age bands and gender values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from casegrid.functions.dates import parse_date

# Upper age of each band, and the spellings of each gender.
AGE_BANDS = [(17, "0-17"), (34, "18-34"), (54, "35-54"), (150, "55+")]
GENDER_SPELLINGS = {
    "male": ["male", "m"],
    "female": ["female", "f"],
    "other": ["other", "undifferentiated"],
}


def birth_date(value: Column, kind: str = "text") -> Column:
    """Birth date from ``YYYY-MM-DD`` text, epoch milliseconds or a date/timestamp column."""
    if kind == "epoch_ms":
        return F.timestamp_millis(value.cast("bigint")).cast("date")
    if kind == "date":
        return value.cast("date")
    return parse_date(value)


def age_years(born: Column, as_of: dt.date) -> Column:
    """Completed years: the difference of the dates read as ``yyyyMMdd`` numbers, in ten thousands.

    A 29 February birthday therefore falls on 1 March. Negative for a birth after ``as_of``.
    """
    today = as_of.year * 10000 + as_of.month * 100 + as_of.day
    return F.floor((F.lit(today) - F.date_format(born, "yyyyMMdd").cast("int")) / 10000.0).cast("int")


def age_band(age: Column) -> Column:
    """Position of the band of an age in ``AGE_BANDS``, NULL for an unusable age."""
    band = F.when(age < 0, F.lit(None).cast("int"))
    for position, (upper, _) in enumerate(AGE_BANDS):
        band = band.when(age <= upper, position)
    return band


def band_label(band: Column) -> Column:
    labels = F.array(*[F.lit(label) for _, label in AGE_BANDS])
    return F.coalesce(F.get(labels, band), F.lit("Unknown"))


def age_group(dob: Column, as_of: dt.date, kind: str = "text") -> Column:
    return band_label(age_band(age_years(birth_date(dob, kind), as_of)))


def gender_code(value: Column) -> Column:
    """Position of the gender in ``GENDER_SPELLINGS``, NULL for anything else."""
    cleaned = F.lower(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", ""))
    spellings = {s: i for i, names in enumerate(GENDER_SPELLINGS.values()) for s in names}
    lookup = F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])
    return F.try_element_at(lookup, cleaned)


def gender_label(code: Column) -> Column:
    labels = F.array(*[F.lit(name) for name in GENDER_SPELLINGS])
    return F.coalesce(F.get(labels, code), F.lit("unknown"))


def normalize_gender(value: Column) -> Column:
    return gender_label(gender_code(value))
