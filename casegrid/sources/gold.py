"""Gold: the fact partitioned by raw condition code, and small dimensions.

A version of the fact holds the partitions it has written; those it has taken over from earlier
versions are named in its manifest and stay where they are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid import schemas
from casegrid.functions.text import safe_code
from casegrid.operators.dedupe import conform
from casegrid.sources import fs

FACT, CONDITIONS, CELLS, CONDITION_CELLS, CONDITION_TEXTS = "fact", "_conditions", "_h3_reference", "_condition_cells", "_condition_texts"
DIMENSIONS = {
    CONDITIONS: schemas.CONDITIONS_DIM, CELLS: schemas.CELLS_DIM, CONDITION_CELLS: schemas.CONDITION_CELLS,
    CONDITION_TEXTS: schemas.CONDITION_TEXTS,
}
CODE = "condition_code"
MANIFEST = "_manifest.json"
DAY_INDEX = "_day_index"


def write_fact(fact: DataFrame, root: str, kept: dict[str, str] | None = None) -> str:
    """One write for all conditions, into a new version of the fact.

    ``rebalance`` gathers each condition into few files and lets AQE split a condition that is too
    large for one task. Rows are ordered by date inside a file, so a date window skips row groups.
    ``kept`` are partitions of earlier versions that belong to this one; they are noted first, so that
    a finished version is never seen without them.
    """
    path = f"{root}/{FACT}/version={time.time_ns() // 1000:020d}"
    if kept:
        fs.create_text(fact.sparkSession, f"{path}/{MANIFEST}", json.dumps(kept))
    (
        conform(fact, schemas.GOLD_FACT)
        .hint("rebalance", "condition_code")
        .sortWithinPartitions("condition_code", "date_key", "h3")
        .write.mode("append" if kept else "errorifexists")
        .partitionBy("condition_code")
        .parquet(path)
    )
    return path


def partition_name(spark: SparkSession, code: str) -> str:
    """Folder name of a condition, escaped as Spark's writer does."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(CODE, code)


def folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Where each partition of a version lies, by folder name."""
    own = {f"{CODE}={name}": f"{path}/{CODE}={name}" for name in fs.partition_values(spark, path, CODE)}
    manifest = f"{path}/{MANIFEST}"
    return {**(json.loads(fs.read_text(spark, manifest)) if fs.exists(spark, manifest) else {}), **own}


def open_fact(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    """The fact of a version; with ``codes`` only these partitions, the others are not even listed."""
    if codes is None and not fs.exists(spark, f"{path}/{MANIFEST}"):
        return spark.read.schema(schemas.GOLD_FACT).parquet(path)
    found = folders(spark, path)
    chosen = found.values() if codes is None else [found[n] for c in codes if (n := partition_name(spark, c)) in found]
    if not chosen:
        return spark.createDataFrame([], schemas.GOLD_FACT)
    rows = spark.read.schema(schemas.GOLD_FACT).option("basePath", path.rsplit("/", 1)[0]).parquet(*chosen)
    return rows.select(*schemas.GOLD_FACT.fieldNames())


def write_changes(fact: DataFrame, root: str, before: str, codes: list[str]) -> str:
    """A new version in which ``fact`` replaces the partitions of ``codes``; all others are taken over as they are."""
    spark = fact.sparkSession
    gone = {partition_name(spark, c) for c in codes}
    return write_fact(fact, root, {name: folder for name, folder in folders(spark, before).items() if name not in gone})


def replace_conditions(fact: DataFrame, path: str) -> None:
    """Overwrite only the condition partitions present in ``fact``; the others stay as they are.

    ``fact`` must not be read from ``path`` itself.
    """
    (
        conform(fact, schemas.GOLD_FACT)
        .hint("rebalance", "condition_code")
        .sortWithinPartitions("condition_code", "date_key", "h3")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("condition_code")
        .parquet(path)
    )


def _newest(spark: SparkSession, root: str, name: str) -> str | None:
    for version in reversed(fs.partition_values(spark, f"{root}/{name}", "version")):
        path = f"{root}/{name}/version={version}"
        if fs.is_complete(spark, path):
            return path
    return None


def read_fact(spark: SparkSession, root: str, condition_code: str | None = None) -> DataFrame | None:
    """Current fact; a condition code prunes to its partition."""
    path = _newest(spark, root, FACT)
    if path is None:
        return None
    fact = open_fact(spark, path)
    return fact if condition_code is None else fact.where(F.col("condition_code") == condition_code)


def write_day_index(index: DataFrame, anchors: Callable[[DataFrame], DataFrame], root: str) -> str:
    """The day index by condition, ordered by word inside files, and the latest days beside it."""
    path = f"{root}/{DAY_INDEX}/version={time.time_ns() // 1000:020d}"
    (
        index.hint("rebalance", CODE).sortWithinPartitions(CODE, "word", "h3")
        .write.mode("errorifexists").partitionBy(CODE).parquet(f"{path}/words")
    )
    written = index.sparkSession.read.schema(index.schema).parquet(f"{path}/words")
    anchors(written).write.mode("errorifexists").parquet(f"{path}/latest")
    return path


def read_day_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The index and the latest day of each condition."""
    words = spark.read.schema(f"{CODE} string, h3 string, age_group string, gender string, word int, bits bigint, running array<bigint>")
    return words.parquet(f"{path}/words"), spark.read.schema(f"{CODE} string, latest int").parquet(f"{path}/latest")


def write_dimension(df: DataFrame, root: str, name: str) -> str:
    """Dimensions are bounded by the code list and the cell grid: one sorted file each."""
    schema = DIMENSIONS[name]
    path = f"{root}/{name}/version={time.time_ns() // 1000:020d}"
    conform(df, schema).orderBy(schema.fieldNames()[0]).write.mode("errorifexists").parquet(path)
    return path


def read_dimension(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    path = _newest(spark, root, name)
    return None if path is None else spark.read.schema(DIMENSIONS[name]).parquet(path)


def code_collisions(codes: DataFrame) -> DataFrame:
    """Condition codes that would share an export name (``a/b`` and ``a_b``)."""
    return (
        codes.select("condition_code").distinct()
        .groupBy(safe_code(F.col("condition_code")).alias("export_name"))
        .agg(F.count("*").alias("codes"), F.min("condition_code").alias("first_code"))
        .where("codes > 1")
    )


def export_fact(fact: DataFrame, path: str) -> None:
    """Publication copy, partitioned by file-safe code. Fails when two codes share a name."""
    clash = code_collisions(fact).take(1)
    if clash:
        raise ValueError(f"condition codes collide on export name {clash[0]['export_name']!r}")
    (
        fact.withColumn("condition", safe_code(F.col("condition_code")))
        .hint("rebalance", "condition")
        .write.mode("errorifexists")
        .partitionBy("condition")
        .parquet(path)
    )


def export_daily_json(fact: DataFrame, path: str) -> None:
    """JSON lines per condition and day."""
    rows = fact.withColumn("condition", F.col("condition_code")).withColumn("day", F.col("date_key"))
    rows.hint("rebalance", "condition", "day").write.mode("errorifexists").partitionBy("condition", "day").json(path)
