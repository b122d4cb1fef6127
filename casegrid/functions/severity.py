"""Severity bands, influence radii and merge thresholds of hotspots."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values of the hotspot display contract.
CASE_SCALE = 50000
SEVERITY_STEPS = [2000, 4000, 6000, 8000, 12000, 16000, 25000]
SEVERITY_COLORS = [
    "#ffff66", "#ffee00", "#ffcc00", "#ffaa00", "#ff8800", "#ff6600", "#ff3300", "#cc0000",
]
MERGE_STEPS_KM = [(2, 900), (3, 650), (5, 240), (7, 50), (9, 15)]
MERGE_MIN_KM = 5
CENTER_WEIGHT_POWER = 1.25
RADIUS_BASE_M, RADIUS_RANGE_M, RADIUS_FACTOR = 120000.0, 180000.0, 1.3
RADIUS_DECAY, RADIUS_FULL_ZOOM = 0.62, 2
FLOOR_BASE_M, FLOOR_RANGE_M, FLOOR_STEEPNESS, FLOOR_MID_ZOOM = 900, 4100, 0.9, 6


def severity_band(cases: Column) -> Column:
    """0 (mild) .. 7 (severe), by unmerged cases."""
    return sum((F.coalesce(cases >= step, F.lit(False)).cast("int") for step in SEVERITY_STEPS), F.lit(0))


def severity_color(cases: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in SEVERITY_COLORS]), severity_band(cases) + 1)


def intensity(cases: Column) -> Column:
    return F.least(F.lit(1.0), cases / F.lit(float(CASE_SCALE)))


def center_weight(cases: Column) -> Column:
    return F.pow(F.greatest(F.lit(1.0), cases.cast("double")), F.lit(CENTER_WEIGHT_POWER))


def _zoom_terms(zoom: float) -> tuple[float, float]:
    """Scale factor and lower limit (m) of the radius at a zoom level."""
    scale = math.exp(-RADIUS_DECAY * max(0.0, zoom - RADIUS_FULL_ZOOM))
    floor = FLOOR_BASE_M + FLOOR_RANGE_M / (1 + math.exp(FLOOR_STEEPNESS * (zoom - FLOOR_MID_ZOOM)))
    return scale, floor


def radius_m(cases: Column, zoom: float) -> Column:
    """Radius of influence in metres: grows with cases, shrinks with zoom."""
    scale, floor = _zoom_terms(zoom)
    return F.greatest(F.lit(floor), (intensity(cases) * RADIUS_RANGE_M + RADIUS_BASE_M) * scale) * RADIUS_FACTOR


def radius_m_at(cases, zoom: float):
    """:func:`radius_m` for numbers or numpy arrays, used inside the grouped greedy merge."""
    import numpy as np

    scale, floor = _zoom_terms(zoom)
    growth = np.minimum(1.0, cases / CASE_SCALE) * RADIUS_RANGE_M
    return np.maximum(floor, (RADIUS_BASE_M + growth) * scale) * RADIUS_FACTOR


def base_threshold_km(zoom: float) -> float:
    for upper, km in MERGE_STEPS_KM:
        if zoom <= upper:
            return float(km)
    return float(MERGE_MIN_KM)


def max_threshold_km(zoom: float) -> float:
    """No two hotspots further apart than this can merge at the zoom level."""
    return max(base_threshold_km(zoom), 2 * float(radius_m_at(float(CASE_SCALE), zoom)) / 1000)
