"""Spatial cells and distances.

A cell is one square of an equal-angle grid, written ``r{resolution}_{row}_{column}``. The number of
cells at a resolution is fixed (see :func:`cell_count`), which bounds every per-cell result however
many events are binned. Totals equal those of any other binning; per-cell membership is the grid's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

DEFAULT_RESOLUTION = 4
EARTH_RADIUS_KM = 6371
# Kilometres per degree used by the distance prefilters.
KM_PER_LAT_DEGREE = 110.574
KM_PER_LON_DEGREE = 111.32
MIN_KM_PER_LON_DEGREE = 8.0


def cell_size(resolution: int) -> float:
    """Cell edge in degrees; a binary fraction, so row and column arithmetic is exact."""
    return 180.0 / 2 ** (resolution + 5)


def cell_count(resolution: int) -> int:
    """Number of cells on the whole globe: 524 288 at resolution 4."""
    return 2 ** (resolution + 5) * 2 ** (resolution + 6)


def cell_key(lat: Column, lng: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Cell of a coordinate as a number; NULL, NaN and out-of-range coordinates -> NULL.

    Eight fixed bytes, where the text id takes two dozen in a shuffled row: group and join by this
    and turn it into text afterwards.
    """
    size, rows = cell_size(resolution), 2 ** (resolution + 5)
    row = F.least(F.floor((lat + 90.0) / size), F.lit(rows - 1))
    column = F.least(F.floor((lng + 180.0) / size), F.lit(2 * rows - 1))
    valid = lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)
    return F.when(valid, row * (2 * rows) + column)


def cell_name(key: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Text id of a cell key. A row of the grid has a power of two of cells."""
    bits = resolution + 6
    return F.concat_ws(
        "_",
        F.when(key.isNotNull(), f"r{resolution}"),
        F.shiftright(key, bits).cast("string"),
        key.bitwiseAND(F.lit(2**bits - 1).cast("bigint")).cast("string"),
    )


def cell_id(lat: Column, lng: Column, resolution: int = DEFAULT_RESOLUTION) -> Column:
    """Text id of the cell of a coordinate, NULL where there is none."""
    key = cell_key(lat, lng, resolution)
    return F.nullif(cell_name(key, resolution), F.lit(""))


def cell_center(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the middle of a cell; NULL for any other text."""
    shape = r"^r(\d{1,2})_(\d{1,9})_(\d{1,9})$"
    part = lambda group: F.regexp_extract(cell, shape, group).try_cast("double")
    size = F.lit(180.0) / F.pow(F.lit(2.0), part(1) + 5.0)
    return (part(2) + 0.5) * size - 90.0, (part(3) + 0.5) * size - 180.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(half_lat), 2.0) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2.0)
    )
    chord = F.least(F.lit(1.0), chord)
    return F.atan2(F.sqrt(chord), F.sqrt(1.0 - chord)) * (2.0 * EARTH_RADIUS_KM)


def longitude_gap(lng1: Column, lng2: Column) -> Column:
    """Degrees between two longitudes, the short way round."""
    gap = F.abs(lng1 - lng2)
    return F.when(gap > 180.0, 360.0 - gap).otherwise(gap)


def km_per_lon_degree(lat: Column) -> Column:
    return F.greatest(F.lit(MIN_KM_PER_LON_DEGREE), F.cos(F.radians(lat)) * KM_PER_LON_DEGREE)
