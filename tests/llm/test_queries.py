"""The registered queries at the smallest scale, and the pipeline against a plain version."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from collections import Counter

import __spark_entry__ as contract
import check
import corpus_pipeline
from casegrid.llm import bpe, cotraining, queries
from casegrid.llm.common import table
from casegrid.llm.line_dedup import MIN_CHARS
from test_corpus_operators import WORD, components, lower, plain_lines, shingles

SF = "/root/testdata/sf0.001"
WITH_SQL = {
    "op2_warc_revisits", "op3_perspective_rotation", "op7_line_dedup", "op11_minhash_hamming", "op13_collocations",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    outcome, count = check.compare(spark, check.connect(SF), name, SF)
    assert outcome == ("ok" if name in WITH_SQL else "rows only")
    assert count > 0 or name in ("op4_licence_scan", "op8_benchmark_decontamination")


def test_registered():
    assert set(queries.ORACLES) == WITH_SQL
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


def contaminated(text, items):
    words = WORD.findall(lower(text))
    for item in items:
        n = min(5, len(WORD.findall(lower(item))))
        mine = Counter(shingles(item, n))
        size = sum(mine.values())
        theirs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []
        if not n or not set(theirs) & set(mine):
            continue
        for a in range(max(1, len(theirs) - size + 1)):
            w = Counter(theirs[a : a + size])
            shared = sum((w & mine).values())
            if 100 * shared >= 80 * (sum(w.values()) + size - shared):
                return True
    return False


def test_pipeline_against_a_plain_version(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    scores = cotraining.score_documents(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in scores.where("kept").collect()}
    rows = [(d, docs[d]["text"]) for d in sorted(kept)]
    before = dict(rows)
    rows = [(d, t) for d, t in plain_lines(rows, MIN_CHARS) if t == before[d] or t is None or WORD.search(t)]
    first = {d: c for d, _, c in components(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    rows = [(d, t) for d, t in rows if not contaminated(t, items)]
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    )
    expected = []
    for d, t in rows:
        ids = encoding.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), SF).count() == 0
