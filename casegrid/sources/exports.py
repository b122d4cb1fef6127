"""Metadata of the dimensions as JSON lines: one object per code or cell, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casegrid import schemas
from casegrid.functions import geo


def conditions_lines(conditions: DataFrame, generated_at: str) -> DataFrame:
    """Code, label and count of every condition, with the total and the demographic domains in each row."""
    return conditions.select(
        F.lit(generated_at).alias("generated_at"), "condition_code", "condition_display", "patient_count", "total_unique",
        F.array(*[F.lit(v) for v in schemas.AGE_GROUPS]).alias("age_groups"),
        F.array(*[F.lit(v) for v in schemas.GENDERS]).alias("genders"),
    )


def cells_lines(cells: DataFrame, generated_at: str, resolution: int = geo.DEFAULT_RESOLUTION) -> DataFrame:
    """Coordinates of every cell, with the resolution and the total in each row."""
    return cells.select(
        F.lit(generated_at).alias("generated_at"), F.lit(resolution).alias("h3_resolution"), "h3", "latitude", "longitude", "total_unique"
    )


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
