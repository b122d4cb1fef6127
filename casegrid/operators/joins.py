"""Joins of rows with what was aggregated of their groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_groups(df: DataFrame, groups_df: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a frame of one row per group; NULL is a group like any other.

    How the join is done is left to the adaptive planner, which knows the measured bytes: a small
    side is broadcast, otherwise oversized partitions of ``df`` are split.
    """
    keys = {c: f"_group_{i}" for i, c in enumerate(on)}
    right = groups_df.select(*[F.col(c).alias(k) for c, k in keys.items()], *[c for c in groups_df.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return df.join(right, same, how).drop(*keys.values())
