"""The corpus pipeline: quality, repeated lines, near copies, benchmark passages, token digests.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.llm import bpe, cotraining, decontaminate, jaccard_join, line_dedup
from casegrid.llm.common import prepare, table
from casegrid.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotraining.keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one of which nothing is left goes."""
    prepare(spark)
    left = line_dedup.deduplicate_lines(docs, counts=True)
    hollow = (F.col("n_dropped") > 0) & (F.regexp_replace("text", r"[\x09-\x0D\x20]+", "") == "")
    return left.where(~F.coalesce(hollow, F.lit(False))).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    prepare(spark)
    return jaccard_join.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.remove_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document that is left."""
    prepare(spark)
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("byte_level_bpe", tokens),
]

# The classifier is trained, which SQL cannot express; the tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written below the shared folder."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
