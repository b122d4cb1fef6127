"""Operators on single texts against plain Python."""

import hashlib
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from casegrid.llm import bpe, huffman, memo, repetition
from casegrid.llm.bytetext import Texts
from casegrid.llm.library_bpe import PieceEncoder
from casegrid.llm.pieces import split
from casegrid.llm.queries import QUERIES
from casegrid.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERN = regex.compile(public_tokenizers.PATTERN)
LETTERS = " '\n\t  aszreltvdmLé一½9٣!?\"😀'  \r'stre"
EDGE_TEXTS = [
    "", None, " ", "\n\n\n", "a", "don't we'll 's 'S", "  x  ", "é" * 300, "😀" * 50, "日本語のテキスト Привет мир", "<|endoftext|> x",
    "word " * 4000, "".join(random.Random(5).choices("abcdefghimnorst", k=20_000)), "same line\nsame line\nother\nsame line",
]


def texts_of(values):
    return Texts(pa.array(values, pa.string()))


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, again = [line for line in text.split("\n") if WORD.search(line)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    out = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": again, "n_repeat_words": len(inside),
    }
    for n in repetition.NGRAM_LIMITS:
        met, covered = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in met:
                covered |= set(range(i, i + n))
            met.add(gram)
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in covered)
    return out


@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=120), max_size=5))
@settings(max_examples=60, deadline=None)
def test_repetition_measures(values):
    got = repetition.measure(texts_of([*values, *EDGE_TEXTS]))
    for i, text in enumerate([*values, *EDGE_TEXTS]):
        assert {k: int(got[k][i]) for k in plain_measures(text)} == plain_measures(text)


def test_repetition_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    rows = [(1, clean), (2, "a b c"), (3, "spam ham egg " * 100), (4, clean + " " + " ".join(f"w{i}" for i in range(100))), (None, clean), (1, clean)]
    got = repetition.repetition_coverage(spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as kept", "2 as n_words")).collect()
    assert sorted((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in got) == [
        (0, False, True), (1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, True, False)]
    assert repetition.repetition_coverage(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pieces_follow_the_pattern():
    rng = random.Random(1)
    values = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + EDGE_TEXTS
    texts = texts_of(values)
    bounds, counts = split(texts)
    raw = texts.data.tobytes()
    got = iter([raw[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])])
    for value, n in zip(values, counts):
        assert [next(got) for _ in range(n)] == PATTERN.findall(value or "")


@pytest.fixture(scope="module")
def reference_encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("max_states", [200, 100_000])
def test_transducer_encodes_like_the_library(reference_encoding, max_states):
    rng = random.Random(2)
    values = EDGE_TEXTS + ["".join(rng.choice(LETTERS) for _ in range(400)) for _ in range(20)]
    ids, counts = bpe.encode(texts_of(values), bpe.Transducer(bpe.load_ranks(RANKS), max_states))
    expected = [reference_encoding.encode_ordinary(v or "") for v in values]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def deep_size(value):
    return sys.getsizeof(value) + (sum(map(deep_size, value)) if isinstance(value, (tuple, list)) else 0)


def test_what_a_machine_has_learnt_is_small_and_goes_with_the_operator():
    rng = random.Random(5)
    memo.forget()
    machine = bpe.transducer(RANKS)
    bpe.encode(texts_of(["".join(rng.choice(LETTERS) for _ in range(400)) for _ in range(20)]), machine)
    assert len(machine._keys) > 1000
    assert sum(map(deep_size, machine._keys)) < 120 * len(machine._keys)
    assert bpe.transducer(RANKS) is machine
    memo.forget()
    assert bpe.transducer.cache_info().currsize == 0


def test_a_machine_remembers_a_bounded_number_of_pairs(monkeypatch, reference_encoding):
    monkeypatch.setattr(bpe, "MAX_PAIRS", 50, raising=False)
    rng, machine = random.Random(6), bpe.Transducer(bpe.load_ranks(RANKS))
    texts = ["".join(rng.choice(LETTERS) for _ in range(200)) for _ in range(20)]
    ids, _ = bpe.encode(texts_of(texts), machine)
    assert ids.tolist() == [i for t in texts for i in reference_encoding.encode_ordinary(t)]
    assert len(machine.merges._pairs) <= 50
    # Some 90 000 nodes: a dictionary for each took over 20 MB.
    assert sum(sys.getsizeof(x) for x in (machine._labels, machine._children, machine._token)) < 2_000_000


def test_a_worker_gives_its_tables_back_when_no_task_follows(monkeypatch):
    monkeypatch.setattr(memo, "IDLE_SECONDS", 1.0, raising=False)

    def run(batches):
        machines.append(bpe.transducer(RANKS))
        yield from batches

    machines = []
    memo.forget()
    for _ in range(2):
        assert list(memo.lean(run, keep=True)(iter([1, 2]))) == [1, 2]
    assert machines[0] is machines[1]
    assert bpe.transducer.cache_info().currsize == 1
    until = time.monotonic() + 20
    while bpe.transducer.cache_info().currsize and time.monotonic() < until:
        time.sleep(0.1)
    assert bpe.transducer.cache_info().currsize == 0


def test_pairs_that_fit_are_those_that_merges_keep():
    merges = bpe.Merges(bpe.load_ranks(RANKS))
    rng, tokens = random.Random(3), list(merges.ranks)
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert merges._fit(a, b) == (merges.merge(a + b, 1, len(a)) is not None)


def test_token_that_merges_cannot_reach_is_used_for_a_whole_piece_only():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    ids, _ = bpe.encode(texts_of(["abc", "xabc"]), bpe.Transducer(ranks))
    assert ids.tolist() == [256, *b"xabc"]


@given(st.text(max_size=60), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_stream_decoder(text, step):
    vocab = bpe.vocabulary(RANKS)
    single = {bytes([b]): i for i, b in ((i, vocab[0][vocab[1][i]]) for i in range(256))}
    ids = np.array([single[bytes([b])] for b in text.encode("utf-8", "ignore")], np.uint32)
    assert "".join(bpe.decode_stream(ids, vocab, step)) == text.encode("utf-8", "ignore").decode()


def test_stream_decoder_marks_broken_bytes():
    vocab = bpe.vocabulary(RANKS)
    single = {int(vocab[0][vocab[1][i]]): i for i in range(256)}
    for data in (b"a\xe2\x82", b"\xff\xfea", b"\xf0\x9f\x98a\x80"):
        for step in (1, 2, 10):
            ids = np.array([single[b] for b in data], np.uint32)
            assert "".join(bpe.decode_stream(ids, vocab, step)) == data.decode("utf-8", "replace")


def test_bpe_query_digests(spark, reference_encoding):
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'z' as ids", "1 as n_tokens")
    got = sorted(map(tuple, bpe.encode_and_decode(df, RANKS).collect()), key=str)
    expected = []
    for doc_id, text in rows:
        ids = reference_encoding.encode_ordinary(text or "")
        data = (text or "").encode()
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest(), len(data), True))
    assert got == sorted(expected, key=str)
    assert bpe.encode_and_decode(spark.createDataFrame([], "doc_id bigint, text string"), RANKS).count() == 0
    packed = bpe.encode_documents(df, RANKS, ["doc_id", "n_tokens"]).where("doc_id = 5").first()
    assert np.frombuffer(packed["ids"], "<u4").tolist() == reference_encoding.encode_ordinary(EDGE_TEXTS[5])


def test_piece_encoder_follows_the_library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    rng = random.Random(4)
    values = EDGE_TEXTS + ["".join(rng.choice(LETTERS) for _ in range(200)) for _ in range(200)]
    encoder = PieceEncoder(VOCABULARY, max_pieces=100)
    for part in (values[:50], values[50:], values):
        ids, counts = encoder.encode(texts_of(part))
        expected = [tokenizer.encode(v or "", add_special_tokens=False).ids for v in part]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_added_tokens_are_found_as_by_the_library():
    tokenizer, token = Tokenizer.from_file(VOCABULARY), "<|endoftext|>"
    rng = random.Random(7)
    values = ["a <|endoftext|> b", token, token * 2 + "x", "<|endof", "text|>", f"x {token}\n don't{token}'s", "", None, token] + EDGE_TEXTS
    values += ["".join(rng.choice([*LETTERS, token, "<|end", "oftext|>"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    encoder = PieceEncoder(VOCABULARY, max_pieces=100, added_tokens=True)
    for part in (values[:1], values[:9], values):
        ids, counts = encoder.encode(texts_of(part))
        expected = [tokenizer.encode(v or "", add_special_tokens=False).ids for v in part]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_huffman_query_finds_added_tokens(spark, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "after it")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op10_huffman_ids"](spark, str(tmp_path)).collect()}
    at = 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert got[doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("limit", [9, 20])
@pytest.mark.parametrize("size", [0, 1, 2, 400])
def test_huffman_round_trip(size, limit):
    rng = np.random.default_rng(size)
    counts = rng.integers(0, 1500, 20) if size else np.zeros(20, np.int64)
    ids = (rng.zipf(1.3, int(counts.sum())) % max(1, size)).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=max(1, size)), limit)
    assert lengths.max() <= limit and (size < 2 or abs(sum(2.0 ** -lengths[lengths > 0].astype(float)) - 1) < 1e-9)
    payload, n_bytes, marks, _ = huffman.pack(ids, counts, lengths, huffman.canonical_codes(lengths))
    got = huffman.unpack(payload, np.cumsum(n_bytes) - n_bytes, counts, marks.astype(np.int64), huffman.decoding_table(lengths))
    assert np.array_equal(got, ids)


def test_huffman_files(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    rows = [(20 - i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "null id"), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "0 as start", "0 as bucket")
    path = scratch_path(spark, "test-huffman")
    huffman.write_ids(df, VOCABULARY, path)
    got = [tuple(r) for r in huffman.read_ids(spark, path).collect()]
    coded = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(np.array(r[1], "<u2").tobytes()))
    expected, at = [], 0
    for doc_id, ids in sorted(coded, key=key):
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    empty = scratch_path(spark, "test-huffman")
    huffman.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), VOCABULARY, empty)
    assert huffman.read_ids(spark, empty).count() == 0


def test_huffman_blocks_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_BYTES", 500)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(0, 3000)))) for i in range(40)]
    path = scratch_path(spark, "test-huffman")
    huffman.write_ids(spark.createDataFrame(rows, "doc_id bigint, text string"), VOCABULARY, path)
    got = {r["doc_id"]: r for r in huffman.read_ids(spark, path, with_ids=True).collect()}
    tokenizer, at = Tokenizer.from_file(VOCABULARY), 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert np.frombuffer(got[doc_id]["ids"], "<u4").tolist() == ids and got[doc_id]["start"] == at
        at += len(ids)
