"""Near duplicates by MinHash: b-bit signatures joined by a multi-index over their Hamming distance.

A signature has ``components`` values of 16 bits; two sets agree in each with a probability of their
Jaccard similarity. Signatures are split into chunks. If two differ in at most ``radius`` components,
then by the pigeonhole principle some chunk differs in at most ``errors``, so one of the keys made by
leaving out any ``errors`` components of a chunk is equal: no pair within the radius is missed. At a
similarity of 0.8 a pair lies beyond the radius with a probability of 5e-6 (48 components, radius 23).

Sets that share a key are candidates; signatures within the radius and then the whole sets decide.
No long list is turned into all its pairs. Each set is compared with one leader of its lists. What
short lists leave is compared pair by pair, sets of long lists meet on what sets them apart from the
consensus of their group (``near_groups``). Copies that differ from a common original in places of
their own share none of that.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.bytetext import Texts, chunks, mix
from casegrid.llm.common import written
from casegrid.llm.near_groups import FITS, group_pairs, labelled, pair, settled
from casegrid.llm.shingles import Sets
from casegrid.session import scratch_path

SHINGLE = 4
# Most keys or ids (8 bytes each) that are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST = 1 << 20


@dataclass(frozen=True)
class Index:
    """Shape of the signatures and of the index over them."""

    components: int = 48
    chunk: int = 4
    errors: int = 1

    @property
    def radius(self) -> int:
        """The largest distance at which no pair is missed: beyond it every chunk may have one error too many."""
        return (self.errors + 1) * (self.components // self.chunk) - 1

    @property
    def kept(self) -> list[tuple[int, ...]]:
        """The components of each key: of every chunk, all choices of those that must agree."""
        return [
            tuple(first + i for i in chosen)
            for first in range(0, self.components - self.chunk + 1, self.chunk)
            for chosen in itertools.combinations(range(self.chunk), self.chunk - self.errors)
        ]


PRODUCTION = Index()


def signatures(sets: Sets, components: int) -> np.ndarray:
    """16-bit MinHash values, a row per set; those of an empty set are all the same."""
    random = np.random.Generator(np.random.PCG64(4711)).integers(0, 1 << 63, (components, 2), dtype=np.uint64)
    some = np.flatnonzero(sets.sizes)
    out = np.zeros((len(sets.sizes), components), np.uint64)
    if len(some):
        spread = mix(sets.values.astype(np.uint64))
        for i, (salt, factor) in enumerate(random):
            out[some, i] = np.minimum.reduceat((spread ^ salt) * (factor | np.uint64(1)), sets.bounds[some])
    return (mix(out) & np.uint64(0xFFFF)).astype("<u2")


def _rows(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    data = Texts(column).data
    return np.frombuffer(data.tobytes(), "<u2").reshape(len(column), components)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _signed(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id, sid, n, signature`` of every row; the signature only once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")), SHINGLE)
                names = sets.names()
                rows = _rows(signatures(sets, index.components))
                first = np.zeros(len(names), bool)
                first[np.unique(names, return_index=True)[1]] = True
                first &= ~np.isin(names, seen) & (sets.sizes > 0)
                seen = np.concatenate([seen, names[first]])
                rows = pa.compute.if_else(pa.array(first), rows, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names), pa.array(sets.sizes), rows], ["doc_id", "sid", "n", "signature"]
                )

    return _texts(docs).mapInArrow(run, "doc_id bigint, sid bigint, n bigint, signature binary")


def _entries(sets: DataFrame, index: Index) -> DataFrame:
    """``key, sid, n`` for every key of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("signature"), index.components).astype(np.uint64)
            sid, n = batch.column("sid"), batch.column("n")
            for number, kept in enumerate(index.kept):
                key = np.full(len(values), number, np.uint64)
                for component in kept:
                    key = mix(key * np.uint64(0x10001) + values[:, component] + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(1)).astype(np.int64)), sid, n], ["key", "sid", "n"])

    return sets.select("sid", "n", "signature").mapInArrow(run, "key bigint, sid bigint, n bigint")


def _semi(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``ids`` (written before); broadcast only where these are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, column, "left_semi")


def _members(docs: DataFrame, signed: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """``sid, members``: the whole sets of the wanted sids, from the texts of one document of each."""
    sources = _semi(signed.where("n > 0"), wanted, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    ids = written(sources.where("doc_id is not null").select("doc_id").distinct(), path + "-ids")
    texts = _texts(docs)
    rows = _semi(texts.where("doc_id is not null"), ids, "doc_id").unionByName(texts.where("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")), SHINGLE)
                ends = pa.py_buffer((8 * sets.bounds).astype(np.int32))
                members = pa.Array.from_buffers(pa.binary(), len(sets.sizes), [None, ends, pa.py_buffer(sets.values.astype("<i8"))])
                yield pa.RecordBatch.from_arrays([pa.array(sets.names()), members], ["sid", "members"])

    found = _semi(rows.mapInArrow(run, "sid bigint, members binary"), wanted, "sid")
    return written(found.dropDuplicates(["sid"]), path)


def _joined(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    left = sets.select(F.col("sid").alias("a"), F.col(column).alias("left"))
    right = sets.select(F.col("sid").alias("b"), F.col(column).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")


def _links(pairs: DataFrame, sets: DataFrame, members: DataFrame, index: Index, path: str) -> DataFrame:
    """Those ``pairs(a, b)`` that are links: within the radius by signature, then by their whole sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_matrix(batch.column(c), index.components) for c in ("left", "right"))
            yield batch.select(["a", "b"]).filter(pa.array((left != right).sum(axis=1) <= index.radius))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "left"):
                keep = []
                for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist()):
                    both = np.concatenate([np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= 80 * (len(both) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = written(_joined(pairs, sets, "signature").mapInArrow(near, "a bigint, b bigint"), path + "-near")
    return written(_joined(close, members, "members").mapInArrow(similar, "a bigint, b bigint"), path)


def _short_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs of different components in short lists."""
    lists = mixed.where("short")
    return (
        lists.alias("l").join(lists.alias("r"), F.expr(f"l.key = r.key and l.component <> r.component and l.sid < r.sid and {FITS}"))
        .select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b"))
    )


def near_duplicates(docs: DataFrame, index: Index = PRODUCTION) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    A set holds the distinct 4-word shingles of the whole text, A-Z in lower case; a shorter text is
    one shingle, and a text without words, or null, has the empty set and is linked with nothing.
    ``component_id`` is the smallest doc_id that links of Jaccard similarity 0.8 or more reach, itself
    included; equal sets are linked. ``kept`` is ``doc_id = component_id``. Repeated rows get equal
    results; rows with one doc_id and different texts are one node. A row without doc_id gets the
    smallest doc_id that its text reaches and is not kept; where it reaches none, ``component_id`` is
    null and the row is kept. Shingles are compared by 52-bit hashes. Other columns are not looked at.
    """
    root = scratch_path(docs.sparkSession, "minhash")
    _signed(docs, index).write.parquet(f"{root}/signed")
    signed = docs.sparkSession.read.parquet(f"{root}/signed")
    named = signed.where("n > 0")
    sets = written(named.where("signature is not null").dropDuplicates(["sid"]).select("sid", "n", "signature"), f"{root}/sets")

    # Entries of the lists that hold two sets or more.
    entries = _entries(sets, index)
    shared = written(entries.groupBy("key").count().where("count > 1").select("key"), f"{root}/shared")
    lists = written(_semi(entries, shared, "key"), f"{root}/lists")
    listed = written(lists.select("sid").distinct(), f"{root}/listed")
    sets = written(_semi(sets, listed, "sid"), f"{root}/listed-sets")
    members = _members(docs, signed, listed, f"{root}/members")

    # Sets of one doc_id are one node.
    least = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("m")).where("a <> m")
    links = written(named.join(least, "doc_id").where("sid <> a").select("a", F.col("sid").alias("b")).distinct(), f"{root}/same")
    labels = settled(links, f"{root}/labels")

    # Each set against one leader: that with which it shares most lists.
    mixed = labelled(lists, labels, f"{root}/first")
    ranked = mixed.where("component <> commonest").groupBy("sid", "leader").agg(F.count("*").alias("k"))
    ranked = ranked.groupBy("sid").agg(F.max_by("leader", F.struct("k", "leader")).alias("leader"))
    compared = written(ranked.select(*pair("sid", "leader")).distinct(), f"{root}/pairs-first")
    links = links.unionByName(_links(compared, sets, members, index, f"{root}/links-first"))
    labels = settled(links, f"{root}/labels-first")

    # What is left: pairs of different components.
    mixed = labelled(lists, labels, f"{root}/rest")
    rest = _short_pairs(mixed).unionByName(group_pairs(mixed, members, f"{root}/groups"))
    rest = written(rest.distinct().join(compared, ["a", "b"], "left_anti"), f"{root}/pairs-rest")
    more = _links(rest, sets, members, index, f"{root}/links-rest")
    if not more.isEmpty():
        labels = settled(links.unionByName(more), f"{root}/labels-rest")

    found = signed.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    first = found.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    reached = F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id"))
    return (
        found.join(first, "component", "left").withColumn("component_id", reached)
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    )


# Words are split, lower-cased and shingled with lists; links are counted by shingle and followed.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), reached AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, l.component_id, w.doc_id = l.component_id AS kept
FROM w JOIN least l ON l.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
