"""Session settings and registration shared by the queries of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casegrid.session import apply_settings, in_few_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Texts are long: a batch of this many rows stays at a few megabytes, and a task cuts it further.
BATCH_ROWS = "1000"
# A reader holds a column's part of a row group at once, in a buffer outside the heap that its thread keeps.
ROW_GROUP_BYTES = str(8 << 20)


def prepare(spark: SparkSession) -> SparkSession:
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, written in few files and read again; nobody but the job that wrote them looks for a marker of success."""
    options = {"parquet.block.size": ROW_GROUP_BYTES, "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    in_few_files(df).write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB oracle."""

    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
