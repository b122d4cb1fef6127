"""The registered queries, one per operator: ``opN_<name>``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from casegrid.llm import (
    alignment, bpe, chat_rotation, collocations, cotraining, decontaminate, huffman, jaccard_join, licence_scan, line_dedup, minhash_hamming,
    repetition, warc,
)
from casegrid.llm.common import ORACLES, QUERIES, query, table
from casegrid.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


@query("op5_repetition_coverage")
def op5(spark, sf_dir):
    return repetition.repetition_coverage(table(spark, sf_dir, "documents"))


@query("op9_bpe_transducer")
def op9(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks)


@query("op10_huffman_ids")
def op10(spark, sf_dir):
    path = scratch_path(spark, "huffman")
    huffman.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, added_tokens=True)
    return huffman.read_ids(spark, path)


@query("op2_warc_revisits", sql="""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM f
""")
def op2(spark, sf_dir):
    source, target = scratch_path(spark, "warc"), scratch_path(spark, "warc-dedup")
    warc.write_pages(table(spark, sf_dir, "pages"), source)
    warc.deduplicate(spark, source, target)
    return warc.resolved_pages(spark, target)


@query("op6_jaccard_join")
def op6(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op3_perspective_rotation", sql=chat_rotation.ORACLE)
def op3(spark, sf_dir):
    return chat_rotation.rotate_perspectives(table(spark, sf_dir, "conversations"))


@query("op7_line_dedup", sql=line_dedup.ORACLE)
def op7(spark, sf_dir):
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query("op4_licence_scan")
def op4(spark, sf_dir):
    return licence_scan.scan_licences(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_cotraining_quality")
def op1(spark, sf_dir):
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_minhash_hamming", sql=minhash_hamming.ORACLE)
def op11(spark, sf_dir):
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), a, b)


@query("op13_collocations", sql=collocations.ORACLE)
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
