"""Registered queries: every operator over the whole driver tables, with an independent DuckDB oracle."""

from casegrid.queries import (  # noqa: F401
    allocation, gold, hotspots, io, medallion, quality, scalar, state, streaming,
)
from casegrid.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
