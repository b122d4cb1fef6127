"""File manifests and their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.sources import fs


def read_manifest(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """Relative path, size, modification second and content hash of every matching file below ``root``."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(root)
    )
    base = fs.qualified(spark, root).rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.lit(len(base) + 1))
    return files.select(
        relative.alias("path"),
        F.col("length").alias("size"),
        F.unix_seconds("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"),
    )


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """What a sync would do with every path: ``copied``, ``skipped`` (same size and time) or ``stale``."""
    s = source.select("path", F.col("size").alias("s_size"), F.col("modified").alias("s_modified"))
    t = target.select("path", F.col("size").alias("t_size"), F.col("modified").alias("t_modified"))
    same = (F.col("s_size") == F.col("t_size")) & (F.col("s_modified") == F.col("t_modified"))
    action = F.when(F.col("s_size").isNull(), "stale").when(same, "skipped").otherwise("copied")
    return s.join(t, "path", "full_outer").select("path", action.alias("action"))


def stale_paths(source: DataFrame, target: DataFrame) -> DataFrame:
    """Paths of the target that the source does not have."""
    return target.select("path").join(source.select("path"), "path", "left_anti")
