"""Identifier, label and JSON-text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(value: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    trimmed = F.trim(value)
    return F.when(F.length(trimmed) > 0, trimmed)


def canonical_reference(value: Column) -> Column:
    """``Patient/1`` -> ``1``; a text without a slash is kept; blank -> NULL; ``Patient/`` -> ''."""
    return F.element_at(F.split(blank_to_null(value), "/"), -1)


def first_present(*values: Column) -> Column:
    """The first value that is not NULL (coded display, else free text)."""
    return F.coalesce(*values)


def person_name(text: Column, given: Column, family: Column) -> Column:
    """Full name, else given and family joined; '' when all are missing."""
    return F.coalesce(text, F.trim(F.concat_ws(" ", given, family)))


def safe_code(code: Column) -> Column:
    """File-name form of a condition code. Not injective: use it for export names only."""
    return F.translate(code, "/ ", "__")


def display_label(value: Column) -> Column:
    """First letter in upper case, the rest unchanged."""
    return F.concat(F.upper(F.left(value, F.lit(1))), F.substr(value, F.lit(2)))


def composite_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[part.cast("string") for part in parts])


def surrogate_cell_id(ordinal: Column) -> Column:
    """Cell-like id for the zero-based position of an anchor city (six hex digits)."""
    return F.format_string("842a%06xffffffff", ordinal)


def json_string_array(value: Column) -> Column:
    """JSON array text -> array of its non-empty members; anything unreadable -> empty array."""
    parsed = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    return F.filter(parsed, lambda item: F.length(item) > 0)


def with_default(values: Column, default: list[str]) -> Column:
    """The array, or the default list when it is empty."""
    return F.when(F.size(values) > 0, values).otherwise(F.array(*[F.lit(v) for v in default]))


def mentions_any(value: Column, terms: list[str]) -> Column:
    """Case-insensitive: does the text contain one of the terms?"""
    lowered = F.lower(F.coalesce(value, F.lit("")))
    found = F.lit(False)
    for term in terms:
        found = found | lowered.contains(term.lower())
    return found


def stable_uuid(*parts: Column) -> Column:
    """UUID-shaped id that depends on the parts only, so a re-run builds the same bundles."""
    digest = F.sha2(F.concat_ws("|", *[part.cast("string") for part in parts]), 256)
    slices = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in slices])
