"""Date keys, timestamps and query windows."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, functions as F

DATE_KEY_FORMAT = "yyyy-MM-dd"

# Prose layouts understood once no ISO date is found in the text.
PROSE_FORMATS = ["MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy/M/d"]

# Length of the selectable query window, in days.
WINDOW_PRESETS = [1, 7, 30, 90, 180]
WINDOW_DEFAULT = 30
WINDOW_MAX = 180


def parse_timestamp(value: Column) -> Column:
    """Text -> timestamp in UTC; offsets are converted, unreadable text -> NULL."""
    return F.trim(value).try_cast("timestamp")


def parse_date(value: Column) -> Column:
    """Strict ``YYYY-MM-DD`` text -> date, else NULL."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), trimmed.try_cast("date"))


def date_key(value: Column) -> Column:
    return F.date_format(value, DATE_KEY_FORMAT)


def normalize_date_key(value: Column) -> Column:
    """First ISO date inside the text, else one of the prose layouts, else NULL."""
    iso = F.regexp_extract(value, r"(\d{4}-\d{2}-\d{2})", 1)
    trimmed = F.trim(value)
    prose = [F.try_to_timestamp(trimmed, F.lit(layout)) for layout in PROSE_FORMATS]
    return F.coalesce(F.when(F.length(iso) > 0, iso), *[date_key(parsed) for parsed in prose])


def shift_date_key(value: Column, days: Column | int, today: dt.date) -> Column:
    """Date key moved by whole days; an unreadable base counts as ``today``."""
    base = F.coalesce(normalize_date_key(value).try_cast("date"), F.lit(today))
    return date_key(F.date_add(base, days))


def iso_utc(value: Column) -> Column:
    """``2026-01-02T03:04:05Z``; the session runs in UTC."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_date(run_ts: Column, today: dt.date) -> Column:
    """Epoch-millisecond run id -> ``YYYYMMDD``; anything else falls back to ``today``."""
    millis = run_ts.try_cast("bigint")
    return F.coalesce(
        F.date_format(F.timestamp_millis(millis), "yyyyMMdd"), F.lit(today.strftime("%Y%m%d"))
    )


def clamp_window(days: Any) -> int:
    """User-entered window length -> 1..180; zero, blank or text -> 30."""
    try:
        number = float(str(days).strip() or 0)
    except ValueError:
        number = 0.0
    if number != number or number == 0:
        number = WINDOW_DEFAULT
    return int(max(1, min(WINDOW_MAX, number)))


def clamp_window_column(days: Column) -> Column:
    """Column form of :func:`clamp_window`."""
    number = days.try_cast("double")
    usable = F.when(~F.isnan(number) & (number != 0), number)
    bounded = F.least(F.lit(float(WINDOW_MAX)), F.coalesce(usable, F.lit(float(WINDOW_DEFAULT))))
    return F.greatest(F.lit(1.0), bounded).cast("int")
