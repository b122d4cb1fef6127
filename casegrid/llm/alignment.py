r"""Alignment of two tokenizers' tokens: a byte-level BPE (A) with a piece model (B), by whitespace anchors.

Both tokenise the whole of ``space + text``. Tokens that begin with a space mark, where one of each
tokenizer begins at the same byte, are anchors: what lies before is closed for both. Anchors cut a
document into windows of token ids. A token's bytes depend on its id alone, so the alignment of a
window depends on its two tuples of ids alone and is made once per worker and pair of tuples.

Inside a window, bytes where tokens of both end cut the tokens into groups; the two tokens that end
there are a link. Links are counted over the corpus by pair of ids. Of two tokens that end together
the shorter one's bytes are a suffix of the longer one's, so the number of different pairs is bounded
by the vocabularies (:meth:`Vocabularies.most_pairs`), and their counts can be broadcast.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.bytetext import RollingHash, Texts, chunks, mix
from casegrid.llm.memo import Memo, distinct
from casegrid.llm.pieces import split
from casegrid.session import scratch_path

# Pieces, segments or windows that a worker remembers.
REMEMBERED = 1 << 20
B_BITS = 15  # of a code, for the id of B; that of A sits above them
SPACE = 0x20


def _byte_level(token: str, table: dict[str, int]) -> bytes:
    return bytes(table[c] for c in token)


def _byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = _byte_table()
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [
            added[i].encode() if i in added else _byte_level(self.a.id_to_token(i), table)
            for i in range(self.a.get_vocab_size(with_added_tokens=True))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if len(pieces) > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("ids do not fit into a code")
        # Segments are tokenised one by one, which needs that no piece holds a space behind something else.
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces reach over spaces")

    def most_pairs(self) -> int:
        """How many pairs of tokens have one that ends like the other: a bound of the pairs that links can have."""
        a, b = Counter(self.a_bytes), Counter(self.b_bytes)
        inside = sum(b.get(t[i:], 0) for t in self.a_bytes for i in range(len(t)))
        return inside + sum(a.get(t[i:], 0) for t in self.b_bytes for i in range(1, len(t)))


class _Encoder:
    """Ids of whole texts, every distinct span encoded once. A span whose tokens do not give back its bytes is bad."""

    def __init__(self, vocabulary: list[bytes], cut: Callable, encode: Callable[[list[str]], list[list[int]]]):
        self._bytes, self._cut, self._encode = vocabulary, cut, encode
        self._memo = Memo(REMEMBERED)

    def run(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in order, how many each text has, and which texts are given back by them."""
        if self._memo.full:
            self._memo.clear()
        bounds, counts = self._cut(texts)
        keys, first, inverse = distinct(RollingHash(texts.data).spans(bounds[:-1], bounds[1:]))
        entries = self._memo.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            raw = texts.data.tobytes()
            spans = [raw[x:y] for x, y in zip(bounds[first[new]].tolist(), bounds[first[new] + 1].tolist())]
            found = self._encode([s.decode() for s in spans])
            # The first value says whether the ids give back the bytes.
            rows = [[int(b"".join([self._bytes[i] for i in ids]) == s), *ids] for s, ids in zip(spans, found)]
            made = np.fromiter(map(len, rows), np.int64, len(rows))
            entries[new] = self._memo.add(keys[new], np.fromiter((i for r in rows for i in r), np.uint32, int(made.sum())), made)
        values, made = self._memo.gather(entries[inverse])
        heads = np.cumsum(made) - made
        good = values[heads] == 1 if len(heads) else np.zeros(0, bool)
        keep = np.ones(len(values), bool)
        keep[heads] = False
        ends = np.concatenate([[0], np.cumsum(made - 1)])
        at = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[0], np.cumsum(~good)])[at]
        return values[keep], np.diff(ends[at]), np.diff(bad) == 0


def _segments(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Spans that begin at a text or at the first of some spaces."""
    if not len(texts.data):
        return np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    space = texts.data == SPACE
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    begins = np.flatnonzero(start)
    return np.concatenate([begins, [len(texts.data)]]), np.diff(np.searchsorted(begins, texts.offsets))


def _spaced(texts: Texts) -> Texts:
    """A space before every text."""
    out = Texts.__new__(Texts)
    n = len(texts)
    out.offsets = texts.offsets + np.arange(n + 1)
    out.data = np.full(len(texts.data) + n, SPACE, np.uint8)
    out.data[np.arange(len(texts.data)) + np.repeat(np.arange(1, n + 1), np.diff(texts.offsets))] = texts.data
    out.null = texts.null
    return out


class Aligner:
    """Aligns chunks of texts; tokens and windows are remembered between chunks."""

    def __init__(self, vocabularies: Vocabularies):
        v = self._v = vocabularies
        self._a = _Encoder(
            v.a_bytes, split, lambda spans: [e.ids for e in v.a.encode_batch_fast(spans, add_special_tokens=False)]
        )
        alone = [v.b.piece_to_id("▁")]
        # The library puts a space before each segment, which has one already; it leaves an empty text alone.
        self._b = _Encoder(
            v.b_bytes, _segments, lambda spans: [ids or alone for ids in v.b.encode([s[1:] for s in spans], num_threads=1)]
        )
        self._lengths = [np.array([len(t) for t in tokens], np.int64) for tokens in (v.a_bytes, v.b_bytes)]
        self._marked = [np.array([t[:1] == b" " for t in tokens]) for tokens in (v.a_bytes, v.b_bytes)]
        random = np.random.Generator(np.random.PCG64(77))
        self._values = [random.integers(1 << 62, 1 << 63, len(tokens), dtype=np.uint64) for tokens in (v.a_bytes, v.b_bytes)]
        self._windows, self._texts = Memo(REMEMBERED), []

    def _align(self, a: list[int], b: list[int]) -> tuple[bytes, list[int]]:
        """Groups of one window as text, and the codes of its links."""
        a_bytes, b_bytes = self._v.a_bytes, self._v.b_bytes
        groups, links = [], []
        i = j = i0 = j0 = a_end = b_end = 0
        while i < len(a) or j < len(b):
            if a_end <= b_end and i < len(a):
                a_end += len(a_bytes[a[i]])
                i += 1
            else:
                b_end += len(b_bytes[b[j]])
                j += 1
            if a_end == b_end:
                groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
                links.append(a[i - 1] << B_BITS | b[j - 1])
                i0, j0 = i, j
        return ";".join(groups).encode(), links

    def _windows_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of every window of the tokens, and the byte where each begins."""
        starts = []
        for ids, lengths in zip((a, b), self._lengths):
            size = lengths[ids]
            starts.append(np.cumsum(size) - size)
        marked = [s[m[ids]] for s, m, ids in zip(starts, self._marked, (a, b))]
        anchors = np.intersect1d(*marked, assume_unique=True)
        cuts = [np.concatenate([np.searchsorted(s, anchors), [len(s)]]) for s in starts]
        hashes = [RollingHash(ids, v).spans(c[:-1], c[1:]) for ids, v, c in zip((a, b), self._values, cuts)]
        keys = mix(hashes[0]) + hashes[1]
        entries = self._windows.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            distinct_keys, first = np.unique(keys[new], return_index=True)
            place = new[first]
            bounds = [(c[place].tolist(), c[place + 1].tolist()) for c in cuts]
            a_list, b_list = a.tolist(), b.tolist()
            made = [self._align(a_list[w:x], b_list[y:z]) for w, x, y, z in zip(*bounds[0], *bounds[1])]
            self._texts += [text for text, _ in made]
            links = [links for _, links in made]
            counts = np.fromiter(map(len, links), np.int64, len(links))
            added = self._windows.add(distinct_keys, np.fromiter((c for l in links for c in l), np.uint32, int(counts.sum())), counts)
            entries[new] = added[np.searchsorted(distinct_keys, keys[new])]
        return entries, anchors

    def run(self, texts: Texts) -> dict[str, np.ndarray | list]:
        """Per text its numbers of tokens, groups and links, the groups' digest; and the codes of all links with their texts."""
        if self._windows.full:
            self._windows.clear()
            self._texts = []
        n = len(texts)
        some = np.diff(texts.offsets) > 0
        spaced = _spaced(texts)
        (a, a_count, a_good), (b, b_count, b_good) = self._a.run(spaced), self._b.run(spaced)
        good = some & a_good & b_good
        a, b = a[np.repeat(good, a_count)], b[np.repeat(good, b_count)]
        a_count, b_count = a_count * good, b_count * good
        digests, owner = [""] * n, np.zeros(0, np.int64)
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(a):
            entries, begins = self._windows_of(a, b)
            offsets = np.concatenate([[0], np.cumsum((np.diff(spaced.offsets)) * good)])
            at = np.searchsorted(begins, offsets)
            strings, entry = self._texts, entries.tolist()
            for i in np.flatnonzero(good).tolist():
                whole = b";".join([strings[e] for e in entry[at[i] : at[i + 1]]])
                digests[i] = hashlib.sha256(whole).hexdigest()
            codes, counts = self._windows.gather(entries)
            owner = np.repeat(np.searchsorted(offsets, begins, "right") - 1, counts)
        links = np.bincount(owner, minlength=n).astype(np.int64)
        return {"n_a": a_count, "n_b": b_count, "n_links": links, "groups_sha256": digests, "codes": codes, "owner": owner}


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair of tokenizers for a process."""
    return Vocabularies(a_path, b_path)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for a worker process."""
    return Aligner(vocabularies(a_path, b_path))


_ALIGNED = "kind int, doc_id bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, codes binary, counts binary, code bigint, n bigint"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("codes", pa.binary()), ("counts", pa.binary()), ("code", pa.int64()), ("n", pa.int64()),
])


def _batch(**columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = [
        pa.nulls(rows, f.type) if f.name not in columns
        else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
        for f in _ARROW
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values up to each end as one binary value; ``ends`` are numbers of values and begin with 0."""
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1,
        [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))],
    )


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document (kind 0) with the codes of its links, and each task's counts of codes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = aligner(a_path, b_path)
        seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the whole task; bounded by the vocabularies
        for batch in batches:
            for part in chunks(batch, "text"):
                found = machine.run(Texts(part.column("text")))
                n = part.num_rows
                keys, counts = np.unique(found["owner"] << 32 | found["codes"].astype(np.int64), return_counts=True)
                codes, ends = keys & 0xFFFFFFFF, np.searchsorted(keys >> 32, np.arange(n + 1))
                yield _batch(
                    kind=np.zeros(n, np.int32), doc_id=part.column("doc_id"), n_a=found["n_a"], n_b=found["n_b"],
                    n_links=found["n_links"], groups_sha256=found["groups_sha256"],
                    codes=_binaries(codes.astype("<u4"), ends), counts=_binaries(counts.astype("<u4"), ends),
                )
                both, place = np.unique(np.concatenate([seen, codes]), return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([times, counts]), minlength=len(both))
                seen, times = both, total.astype(np.int64)
        if len(seen):
            yield _batch(code=seen, n=times, kind=np.ones(len(seen), np.int32))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _ALIGNED)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs(doc_id, text)``.

    ``a_path`` is a byte-level BPE for the tokenizers library, which gets a space and the text;
    ``b_path`` a piece model, which adds the space itself. A text that is null or empty, or that the
    bytes of its tokens do not give back (one with U+2581, which pieces write for a space), has no
    tokens: zeros and an empty digest. ``n_best`` are links whose pair is as frequent over all
    documents as any with its B id, ties included; ``count_sum`` adds the counts of the pairs of all
    links. Texts are aligned whole, whatever their length; repeated rows count as often as they come,
    and rows without doc_id count as well and keep it null. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "alignment")
    _aligned(docs, a_path, b_path).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(_ALIGNED).parquet(path)

    counted = rows.where("kind = 1").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = counted.toArrow()
    most = vocabularies(a_path, b_path).most_pairs()
    if pairs.num_rows > most:
        raise ValueError(f"{pairs.num_rows} pairs of tokens; the vocabularies allow {most}")
    codes, times = (pairs.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    codes, times = codes[order], times[order].astype(np.int64)
    highest = np.zeros(1 << B_BITS, np.int64)
    np.maximum.at(highest, codes & ((1 << B_BITS) - 1), times)
    best = times == highest[codes & ((1 << B_BITS) - 1)]
    shared = spark.sparkContext.broadcast((codes, times, best))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, best = shared.value
        for batch in batches:
            held = Texts(batch.column("codes"))
            code = np.frombuffer(held.data.tobytes(), "<u4").astype(np.int64)
            n = np.frombuffer(Texts(batch.column("counts")).data.tobytes(), "<u4").astype(np.int64)
            at = np.searchsorted(codes, code)
            ends = held.offsets // 4
            sums = [np.concatenate([[0], np.cumsum(v)])[ends] for v in (n * best[at], n * times[at])] if len(code) else [ends, ends]
            links = batch.column("n_links")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b")), links, links, *(pa.array(np.diff(s)) for s in sums),
                 batch.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return rows.where("kind = 0").drop("kind", "code", "n").mapInArrow(
        count,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    )
