"""Schema conformance, latest-wins dedupe and keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of the schema: present ones cast, missing ones added as typed NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column one side lacks is NULL there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def newest_first(df: DataFrame) -> list[Column]:
    """Recency order: source time, ingestion, processing, then content, so ties are repeatable."""
    order = [
        F.col(c).desc_nulls_last()
        for c in ("source_updated_at", "created_at", "updated_at")
        if c in df.columns
    ]
    # The processing time differs between a run and its re-run, so it stays out of the content hash.
    content = [c for c in df.columns if c != "updated_at"]
    return order + [F.xxhash64(*content).desc()]


def latest_per_key(df: DataFrame, keys: str | list[str], order: list[Column] | None = None) -> DataFrame:
    """First row of every key in the given order.

    Because only row number 1 is kept, Spark discards the losers in each map task before the shuffle
    (``WindowGroupLimit``); a key that owns a third of all rows reaches its reducer as a few rows.
    """
    keys = [keys] if isinstance(keys, str) else keys
    window = Window.partitionBy(*keys).orderBy(*(order or newest_first(df)))
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def split_rejects(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable key, rows without one)."""
    usable = F.coalesce(F.length(key) > 0, F.lit(False))
    return df.where(usable), df.where(~usable)


def merge_snapshot(base: DataFrame | None, delta: DataFrame | None, key: str) -> DataFrame | None:
    """Current state after a batch: newest version of every key of either side."""
    sides = [side for side in (base, delta) if side is not None]
    if not sides:
        return None
    usable, _ = split_rejects(union_all(*sides), key)
    return latest_per_key(usable, key)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same keys; all other rows stay.

    An anti-join instead of a window over both sides: a small ``new`` is broadcast once its size is
    known, and then ``existing`` is not shuffled at all.
    """
    kept = existing.join(new.select(*keys), on=keys, how="left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def add_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key it does not have yet."""
    return existing.unionByName(new.join(existing.select(*keys), on=keys, how="left_anti"))


def cap_per_group(df: DataFrame, group: str, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows of each group (a fetch cap), in an order without ties.

    Numbered without gathering a group in one task, whatever its size and the limit. Runs a job.
    """
    from casegrid.operators.ranking import distributed_row_number

    return distributed_row_number(df, order, [group], "_rank").where(F.col("_rank") <= limit).drop("_rank")
