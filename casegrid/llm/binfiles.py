"""Binary files through Spark's own writer and reader, on any file system that Spark reaches.

The text writer puts out the bytes of a value as they are and a separator after each. A binary value
cast to string keeps its bytes, so the rows of a partition become one file of records. The format
chooses a separator that its readers skip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_records(records: DataFrame, path: str, separator: bytes, per_file: int = 0) -> None:
    """Column ``value`` (binary) of every row in order, each followed by ``separator``.

    One file per partition, or more where it has over ``per_file`` rows.
    """
    (
        records.select(F.col("value").cast("string").alias("value"))
        .write.format("text").option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", per_file).save(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of every file below ``path``; a file has to be smaller than 2 GB."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", "content")
