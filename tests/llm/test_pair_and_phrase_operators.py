"""MinHash join, alignment of tokenizers and collocations against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from casegrid.llm import alignment, bpe, collocations, jaccard_join, minhash_hamming
from casegrid.llm.bytetext import Texts, chunks
from casegrid.llm.memo import Memo
from casegrid.llm.pieces import split
from casegrid.llm.shingles import Sets
from casegrid.session import scratch_path
from test_corpus_operators import corpus, edited, lower, shingles

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- MinHash


def near(rows, n=4):
    sets = [(d, frozenset(shingles(t, n))) for d, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, s)), (j, (b, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t) or a is not None and a == b and s and t:
            parent[root(j)] = root(i)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, s) in enumerate(sets):
        least = min((x for x in groups[root(i)] if x is not None), default=None) if s else d
        out.append((d, len(s), least, least is None if d is None else d == least))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as sid", "2 as key", "3 as component", "4 as n", "5 as kept")
    assert order(minhash_hamming.near_duplicates(docs).collect()) == order(near(rows))


def test_near_duplicates_of_odd_rows(spark):
    base = [f"b{i}" for i in range(60)]
    text = " ".join(base)
    rows = [
        (None, text), (None, text + " x"), (7, " ".join(base[1:])), (7, " ".join(base[1:])), (9, "one two"), (9, "three four five six"),
        (3, "THREE four five six"), (None, "alone " * 3), (None, ""), (None, None), (5, ""), (6, None), (4, "w " * 50_000 + text),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert order(minhash_hamming.near_duplicates(docs).collect()) == order(near(rows))
    assert minhash_hamming.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_without_links_to_the_centre(spark):
    """A large group in which many are linked only to others than the leaders."""
    rng = random.Random(3)
    base = [f"h{i}" for i in range(120)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randrange(0, 9))) for _ in range(150)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert order(minhash_hamming.near_duplicates(docs).collect()) == order(near(rows))


@pytest.mark.parametrize("shape", [(48, 4, 1), (12, 4, 2), (10, 5, 1), (9, 3, 1)])
def test_signatures_within_the_radius_share_a_key(shape):
    index = minhash_hamming.Index(*shape)
    rng = random.Random(1)
    for _ in range(300):
        wrong = set(rng.sample(range(index.components), index.radius))
        assert any(not wrong & set(kept) for kept in index.kept)
    # One more and there is a way to hit every key.
    spread = [first + i for first in range(0, index.components, index.chunk) for i in range(index.errors + 1)]
    assert len(spread) == index.radius + 1 and all(set(spread) & set(kept) for kept in index.kept)


def test_signatures_agree_as_often_as_sets():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    pairs = [(" ".join(words), " ".join(edited(rng, words, 150))) for _ in range(20)]
    sets = Sets(Texts(pa.array([t for p in pairs for t in p])), 4)
    signed = minhash_hamming.signatures(sets, 400)
    for i, (x, y) in enumerate(pairs):
        s, t = set(shingles(x, 4)), set(shingles(y, 4))
        assert abs((signed[2 * i] == signed[2 * i + 1]).mean() - len(s & t) / len(s | t)) < 0.1


def test_many_short_texts_in_one_batch(spark):
    """More texts than fit beside a hash, whatever number of rows the session puts into a batch."""
    rows = [(i, " ".join(f"t{i // 2}w{k}" for k in range(30)) + (" end" if i % 2 else "")) for i in range(3000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        for found in (jaccard_join.jaccard_components(docs), minhash_hamming.near_duplicates(docs)):
            assert found.where("component_id = doc_id - doc_id % 2").count() == 3000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])
    assert max(part.num_rows for part in chunks(batch, "text")) <= 1000


# --- Alignment of tokenizers


def plain_alignment(rows):
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    vocabularies = alignment.vocabularies(A, B)
    documents, counts = [], Counter()
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        ends = []
        for ids, tokens in ((a, vocabularies.a_bytes), (b, vocabularies.b_bytes)):
            ends.append(dict(zip(itertools.accumulate(len(tokens[i]) for i in ids), range(len(ids)))))
            if b"".join(tokens[i] for i in ids) != whole:
                a = b = ()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])) if a else ():
            x, y = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        documents.append((d, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return order(
        (d, a, b, len(l), len(l), sum(counts[p] == highest[p[1]] for p in l), sum(counts[p] for p in l), digest) for d, a, b, l, digest in documents
    )


def odd_texts():
    rng = random.Random(4)
    letters = "  aaeinrst\n\t.,'é一😀9-_▁"
    return [
        None, "", " ", "   ", "a", " a", "a ", "a  b", "\n", "x▁y", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "it's  we'll\r\n\r\n 12 345",
        "日本語 текст 😀😀", "\0\x7f﻿​\xa0", "long" * 3000, "word " * 3000, "same same same", "same same same",
        *("".join(rng.choice(letters[:-1]) for _ in range(rng.randrange(80))) for _ in range(60)),
        *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(20)),
    ]


def test_alignment(spark):
    rows = [*enumerate(odd_texts()), (None, "no id here"), (3, "repeated id"), (3, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 as codes", "2 as n", "3 as kind", "4 as n_links")
    assert order(alignment.align_tokenizers(docs, A, B).collect()) == plain_alignment(rows)
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_alignment_forgets_nothing_that_matters(monkeypatch):
    """Workers with hardly any memory give the same."""
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    texts = Texts(pa.array(odd_texts()))
    small, large = alignment.Aligner(alignment.vocabularies(A, B)), alignment.aligner(A, B)
    small.run(texts)
    first, second = small.run(texts), large.run(texts)
    assert all(np.array_equal(first[k], second[k]) for k in second)


def test_pairs_are_bounded_by_the_vocabularies():
    vocabularies = alignment.Vocabularies.__new__(alignment.Vocabularies)
    vocabularies.a_bytes, vocabularies.b_bytes = [b"a", b"ba", b"c", b" a"], [b"a", b"cba", b"c", b"a"]
    ends = lambda x, y: x.endswith(y) or y.endswith(x)
    assert vocabularies.most_pairs() == sum(ends(x, y) for x in vocabularies.a_bytes for y in vocabularies.b_bytes)


def test_memo():
    rng = np.random.default_rng(1)
    memo, known = Memo(1 << 30), {}
    for _ in range(30):
        keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
        counts = rng.integers(0, 4, len(keys))
        values = rng.integers(0, 1 << 32, int(counts.sum()), dtype=np.uint32)
        added = memo.add(keys, values, counts)
        got, made = memo.gather(added)
        assert np.array_equal(got, values) and np.array_equal(made, counts)
        known.update(zip(keys.tolist(), np.split(values, np.cumsum(counts)[:-1])))
    keys = np.array(list(known), np.uint64)
    at = memo.find(keys)
    assert (at >= 0).mean() > 0.9
    for k, e in zip(keys[at >= 0][:2000].tolist(), at[at >= 0][:2000]):
        assert np.array_equal(memo.gather(np.array([e]))[0], known[k])
    assert (memo.find(np.array([1 << 50], np.uint64)) < 0).all()


def test_memo_cleared_when_it_holds_more_than_a_new_one_has_room_for():
    rng = np.random.default_rng(2)
    memo = Memo(50_000)
    for _ in range(3):
        keys = np.unique(rng.integers(0, 1 << 63, 70_000, dtype=np.uint64))
        counts = np.full(len(keys), 6)
        values = rng.integers(0, 1 << 32, int(counts.sum()), dtype=np.uint32)
        added = memo.add(keys, values, counts)
        assert memo.full and np.array_equal(memo.gather(added)[0], values)
        memo.clear()
        assert not memo.full and (memo.find(keys) < 0).all()


def test_character_classes_of_the_libraries():
    """Every code point between letters, digits and marks, against both libraries."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    tokenizer = Tokenizer.from_file(A).pre_tokenizer
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    machine = bpe.transducer(RANKS)
    for k in range(0, len(points), 4000):
        values = ["".join(f"a{chr(c)}a {chr(c)}1{chr(c)}!" for c in points[j : j + 50]) for j in range(k, min(k + 4000, len(points)), 50)]
        texts = Texts(pa.array(values))
        bounds, counts = split(texts)
        ids, n_ids = bpe.encode(texts, machine)
        at, done = 0, 0
        for value, n, m in zip(values, counts, n_ids):
            pieces = [b - a for _, (a, b) in tokenizer.pre_tokenize_str(value)]
            assert len(pieces) == n, hex(ord(value[1]))
            assert ids[done : done + m].tolist() == encoding.encode_ordinary(value), hex(ord(value[1]))
            at, done = at + n, done + m


# --- Collocations


def plain_collocations(rows, longest, threshold, best):
    found, total = Counter(), Counter()
    for lang, text in rows:
        text = lower(text)
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\0")
        for piece in text.split("\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total["und" if lang is None else lang] += len(words)
            for n in range(1, longest + 1):
                found.update(("und" if lang is None else lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    some = {k: n for k, n in found.items() if len(k[1]) > 1 and n >= threshold}
    out = {}
    for (lang, phrase), a in some.items():
        longer = (
            m for (other, q), m in some.items()
            if other == lang and len(q) > len(phrase) and any(q[i : i + len(phrase)] == phrase for i in range(len(q)))
        )
        if any(100 * m >= 80 * a for m in longer):
            continue
        cuts = [(found[lang, phrase[:k]], found[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, (l, r) = min((2_000_000 * a // (l + r), k, (l, r)) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return [
        (lang, i, p.decode(), -a, l, r, total[lang], -score)
        for lang, phrases in sorted(out.items()) for i, (score, a, p, l, r) in enumerate(sorted(phrases)[:best], 1)
    ]


def prose(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "Ab", "aB", " ", "x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","])
             for _ in range(rng.randrange(0, 60)))) for _ in range(120)]
    return rows + [("en", "one two three four five six " * 3), ("en", "a a a a a a"), ("", "b c " * 9), ("en", None), (None, ""), ("xx", "... , \n"), ("en", "y " * 3000)] * 2


@pytest.mark.parametrize("shards,threshold,best", [(1, 4, 2000), (3, 5, 2000), (4, 2, 7)])
def test_collocations(spark, shards, threshold, best):
    rows = prose(shards)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as hash", "2 as n", "3 as size", "4 as kind").repartition(3)
    got = collocations.collocations(docs, threshold=threshold, best=best, shards=shards).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations(rows, 4, threshold, best))


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "once only")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_a_phrase_is_told_by_its_parts_and_hashed_alike_in_sql(spark):
    assert "hash" not in collocations._SEEN  # what every occurrence takes through the shuffles
    values = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 64, (2, 200), dtype=np.uint64)
    rows = spark.createDataFrame([(2, *map(int, pair)) for pair in values.view(np.int64).T], "size int, prefix bigint, suffix bigint")
    got = [r["h"] for r in rows.selectExpr(f"{collocations.HASH} as h").collect()]
    assert got == collocations._joined(*values).view(np.int64).tolist()
    assert rows.selectExpr("1 as size", "prefix", "suffix").where(f"{collocations.HASH} <> prefix").count() == 0


def test_phrases_are_counted_for_one_cycle(spark):
    """Counts are exact although longer phrases start in the middle of a cycle, and no step scans more than a shard."""
    rows = [("en", "one two three four")] * 40 + [("en", "late pair")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    phrases, langs = collocations.count_phrases(docs, scratch_path(spark, "test"), threshold=3, shards=4)
    assert Counter(r["n"] for r in phrases.collect()) == {40: 10}
    assert [tuple(r) for r in langs.collect()] == [("en", 164)]
