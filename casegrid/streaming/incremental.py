"""Bronze as a file stream: the checkpoint takes the place of the ingestion cursor."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from casegrid import schemas
from casegrid.functions import geo
from casegrid.plans.bronze_to_silver import STATE_ID, extract
from casegrid.plans.layout import Layout
from casegrid.plans.silver_to_gold import refresh_gold
from casegrid.sources import fhir, silver, state


GOLD_SOURCE = "gold_source_tables"


def read_bronze_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """New Bronze files as they appear. ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schemas.BRONZE)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(root)


def _apply_batch(
    batch: DataFrame, batch_id: int, layout: Layout, stream: str, clock: Callable[[], dt.datetime]
) -> None:
    """Merge one micro-batch into new Silver snapshots and publish them.

    The batch id is published together with the snapshots, so a batch that is delivered again after
    a failure changes nothing.
    """
    spark = batch.sparkSession
    base = state.snapshot(spark, layout.state)
    pointer = state.run_state(base, STATE_ID) or {}
    if pointer.get("stream") == stream and pointer.get("batch_id", -1) >= batch_id:
        return
    before = dict(pointer.get("tables", {}))
    after = dict(before)
    now = clock()
    # Which of the five types arrived: read from the partition column alone.
    kinds = batch.select("resource_type").where(F.col("resource_type").isin(list(fhir.RESOURCES)))
    arrived = {row[0] for row in kinds.distinct().collect()}
    for resource_type, (table, _, _) in fhir.RESOURCES.items():
        if resource_type not in arrived:
            continue
        fresh, rejects = extract(batch.where(F.col("resource_type") == resource_type), resource_type, now)
        run_ts = str(int(now.timestamp() * 1000))
        after[table] = silver.merge_delta(spark, before.get(table), fresh, layout.silver, table, run_ts)
        # A batch that is delivered again writes the same folder again.
        rejects.write.mode("overwrite").parquet(f"{layout.rejects}/{table}/batch={stream}-{batch_id}")
    pointed = state.run_state_change(
        STATE_ID, str(int(now.timestamp() * 1000)), now, stream=stream, batch_id=batch_id, tables=after
    )
    state.publish(spark, layout.state, base, pointed, (state.state_name(STATE_ID),))


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def stream_silver(
    spark: SparkSession,
    layout: Layout,
    checkpoint: str,
    stream: str = "bronze",
    max_files: int | None = None,
    clock: Callable[[], dt.datetime] = _utc_now,
) -> StreamingQuery:
    """Latest-wins upsert of everything new in Bronze, then stop (``availableNow``)."""

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        _apply_batch(batch, batch_id, layout, stream, clock)

    return _start(read_bronze_stream(spark, layout.bronze, max_files), upsert_batch, checkpoint)


def stream_gold(
    spark: SparkSession,
    layout: Layout,
    checkpoint: str,
    as_of: dt.date,
    stream: str = "bronze",
    max_files: int | None = None,
    resolution: int = geo.DEFAULT_RESOLUTION,
    clock: Callable[[], dt.datetime] = _utc_now,
) -> StreamingQuery:
    """:func:`stream_silver`, and after each batch a recount of the Gold groups it touched."""

    def refresh_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        _apply_batch(batch, batch_id, layout, stream, clock)
        # Compared by what Gold was last built from, so a batch that failed between Silver and Gold
        # is made up for when it is delivered again.
        tables = state.get_run_state(session, layout.state, STATE_ID)["tables"]
        source = state.get_run_state(session, layout.state, GOLD_SOURCE) or {}
        built_from = source.get("tables", {})
        if tables != built_from or source.get("as_of") != as_of.isoformat():
            refresh_gold(session, layout, built_from, tables, as_of, clock(), resolution)
            state.set_run_state(
                session, layout.state, GOLD_SOURCE, str(batch_id), clock(), tables=tables, as_of=as_of.isoformat()
            )

    return _start(read_bronze_stream(spark, layout.bronze, max_files), refresh_batch, checkpoint)


def _start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
