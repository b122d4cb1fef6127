"""Token ids in files: canonical length-limited Huffman codes from global counts.

A file is a run of records, each followed by ``MARK``. The first holds the code lengths; the others
are blocks of consecutive documents, in ascending ``doc_id`` order over all files in name order. A
document's codes begin at a byte, and the bit offset of every ``CHECKPOINT``-th id is kept, so that
the segments in between decode side by side through one table. Blocks need nothing but the code.

Record: kind (4 bytes), length of the rest (8), rest.
Code record ``HCOD``: zlib-packed array of one length byte per id.
Block ``HBLK``: number of documents (8), first id position in the whole table (8); then arrays of
doc_id (8 each), doc_id present (1), ids (8), payload bytes (8), checkpoints (4 each) and the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.llm.binfiles import read_files, write_records
from casegrid.llm.bytetext import Texts, chunks
from casegrid.llm.library_bpe import piece_encoder
from casegrid.session import scratch_path

MARK = b"\xf0HUFSYNC\x0a"
MAX_LENGTH = 20  # bits of the longest code; the decoding table has 2**20 entries
CHECKPOINT = 512
BLOCK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
# Keys taken to the driver to cut the table into ranges.
SAMPLE_KEYS = 20_000
END_ID = 0


def code_lengths(counts: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaf_masks, packages = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate([weights, packages])
        rank = np.argsort(items, kind="stable")
        leaf_masks.append(rank < len(weights))
        items = items[rank]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for mask in reversed(leaf_masks):
        leaves = int(mask[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of every id: ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        widths = (1 << (MAX_LENGTH - size)).astype(np.int64)
        codes[order] = ((np.cumsum(widths) - widths) >> (MAX_LENGTH - size)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``MAX_LENGTH`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    widths = 1 << (MAX_LENGTH - size)
    ids, sizes = np.repeat(order.astype(np.uint32), widths), np.repeat(size.astype(np.uint8), widths)
    rest = (1 << MAX_LENGTH) - len(ids)
    return np.concatenate([ids, np.zeros(rest, np.uint32)]), np.concatenate([sizes, np.ones(rest, np.uint8)])


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Payload bytes of all documents, bytes of each, and the bit offsets of each one's checkpoints."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(counts)
    sums = np.concatenate([[0], np.cumsum(size)])
    bits = sums[ends] - sums[ends - counts]
    n_bytes = (bits + 7) // 8
    begin = np.cumsum(n_bytes) - n_bytes
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = sums[:-1] - sums[ends - counts][owner]
    at = inside + 8 * begin[owner]
    out = np.zeros(int(n_bytes.sum()) // 4 + 3, np.uint64)
    if len(ids):
        word = at >> 5
        value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out[word[cut]] |= np.bitwise_or.reduceat(value >> np.uint64(32), cut)
        out[word[cut] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), cut)
    payload = out.astype(">u4").tobytes()[: int(n_bytes.sum())]
    number = np.arange(len(ids)) - (ends - counts)[owner]
    marks = np.flatnonzero((number % CHECKPOINT == 0) & (number > 0))
    return payload, n_bytes, inside[marks].astype("<u4"), np.maximum(0, (counts - 1) // CHECKPOINT)


def unpack(payload: bytes, begin: np.ndarray, counts: np.ndarray, checkpoints: np.ndarray, table) -> np.ndarray:
    """Ids of documents whose codes begin at bytes ``begin``; all segments advance together."""
    symbols, sizes = table
    data = np.frombuffer(payload + bytes(8), np.uint8)
    segments = np.maximum(1, (counts + CHECKPOINT - 1) // CHECKPOINT)
    owner = np.repeat(np.arange(len(counts)), segments)
    number = np.arange(len(owner)) - (np.cumsum(segments) - segments)[owner]
    offset = np.zeros(len(owner), np.int64)
    offset[number > 0] = checkpoints
    place = np.concatenate([[0], np.cumsum(counts)])[:-1][owner] + number * CHECKPOINT
    todo = np.minimum(counts[owner] - number * CHECKPOINT, CHECKPOINT)
    order = np.argsort(-todo, kind="stable")
    bit, place, todo = (8 * begin[owner] + offset)[order], place[order], todo[order]
    ids = np.zeros(int(counts.sum()), np.uint32)
    for k in range(int(todo[0]) if len(todo) else 0):
        going = int(np.searchsorted(-todo, -k, "left"))
        now = bit[:going]
        byte = now >> 3
        window = data[byte].astype(np.uint32) << 24 | data[byte + 1].astype(np.uint32) << 16
        window |= data[byte + 2].astype(np.uint32) << 8 | data[byte + 3]
        entry = (window << (now & 7).astype(np.uint32)) >> np.uint32(32 - MAX_LENGTH)
        ids[place[:going] + k] = symbols[entry]
        now += sizes[entry]
    return ids


def _record(kind: bytes, rest: bytes) -> bytes:
    return kind + struct.pack("<Q", len(rest)) + rest


def _ids_table(docs: DataFrame, tokenizer_path: str, path: str, added_tokens: bool) -> DataFrame:
    """Tokenise once: ``doc_id, tie, n_tokens, ids``, with the end id, written below the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_path, added_tokens)
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, counts = encoder.encode(Texts(part.column("text")))
                ids = np.insert(ids, np.cumsum(counts), END_ID)
                counts = counts + 1
                width = np.dtype(kind).itemsize
                offsets = np.concatenate([[0], np.cumsum(counts * width)]).astype(np.int32)
                data = ids.astype(kind)
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                ends = np.cumsum(counts)
                ties = [zlib.crc32(data[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
                widths = pa.array(np.full(len(counts), width, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ties, pa.int64()), pa.array(counts.astype(np.int64)), widths, packed],
                    ["doc_id", "tie", "n_tokens", "width", "ids"],
                )

    selected = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = selected.mapInArrow(run, "doc_id bigint, tie bigint, n_tokens bigint, width int, ids binary")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _cuts(keys: DataFrame, n: int, parts: int) -> list[tuple[int, int]]:
    """Bounds of ``parts`` ranges of (doc_id, tie), from a sample of at most about ``SAMPLE_KEYS`` keys."""
    share = min(1.0, SAMPLE_KEYS / max(1, n))
    picked = keys.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1))
    some = sorted((r[0], r[1]) for r in picked.select(F.coalesce("doc_id", F.lit(-(1 << 63))), "tie").collect())
    return sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []


def _bucket(batch: pa.RecordBatch, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The range that each row falls into."""
    ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    ties = batch.column("tie").to_numpy(zero_copy_only=False)
    first = np.array([c[0] for c in cuts], np.int64)
    low, high = np.searchsorted(first, ids, "left"), np.searchsorted(first, ids, "right")
    for k in np.flatnonzero(low < high):  # the same doc_id as a bound
        low[k] += sum(cut[1] <= ties[k] for cut in cuts[low[k] : high[k]])
    return low


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    if not batch.num_rows:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    kind = f"<u{batch.column('width')[0].as_py()}"
    column = batch.column("ids")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    raw = np.frombuffer(column.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if offsets[-1] > offsets[0] else b""
    return np.frombuffer(raw, kind).astype(np.uint32), batch.column("n_tokens").to_numpy(zero_copy_only=False)


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, added_tokens: bool = False) -> None:
    """Encode ``docs(doc_id, text)`` and write the files below ``path``.

    A null text is empty and has the end id alone. Rows come in ascending (doc_id, CRC of the ids)
    order, nulls first; rows with equal ids and texts are interchangeable. With ``added_tokens`` the
    file's added tokens are found in texts, as by the library's default; without, they are text. To the driver go a bounded
    sample of keys, the counts of the vocabulary's ids and one sum per range.
    """
    spark = docs.sparkSession
    table = _ids_table(docs, tokenizer_path, scratch_path(spark, "ids"), added_tokens)
    size = table.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    parts = max(1, -(-2 * int(size[1]) // FILE_BYTES), min(int(size[0]), spark.sparkContext.defaultParallelism))
    cuts = _cuts(table, int(size[0]), parts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(0, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            ids, n = _ids_of(batch)
            more = np.bincount(ids)
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
            np.add.at(sums, _bucket(batch, cuts), n)
        for kind, values in ((0, counts), (1, sums)):
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int64)), pa.array(values[at])], ["kind", "at", "n"]
            )

    totals = table.mapInArrow(tally, "kind int, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([r["at"] for r in totals if r["kind"] == 0], default=0), np.int64)
    sums = np.zeros(len(cuts) + 2, np.int64)
    for r in totals:
        if r["kind"] == 0:
            counts[r["at"]] = r["n"]
        else:
            sums[r["at"] + 1] = r["n"]
    lengths, starts = code_lengths(counts), np.cumsum(sums)
    codes = canonical_codes(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ids"):
                ids, n = _ids_of(part)
                payload, n_bytes, marks, n_marks = pack(ids, n, lengths, codes)
                cells = []
                for data, sizes in ((payload, n_bytes), (marks.tobytes(), 4 * n_marks)):
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    cells.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
                columns = [part.column(c) for c in ("doc_id", "tie", "n_tokens")]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(_bucket(part, cuts).astype(np.int32))] + cells,
                    ["doc_id", "tie", "n_tokens", "bucket", "payload", "marks"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held, size = None, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            ids = rows.column("doc_id").combine_chunks()
            n = rows.column("n_tokens").to_numpy()
            payloads = rows.column("payload").to_pylist()
            rest = b"".join([
                struct.pack("<QQ", len(n), start), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), n.astype("<u8").tobytes(),
                np.array([len(p) for p in payloads], "<u8").tobytes(), *rows.column("marks").to_pylist(), *payloads,
            ])
            return pa.RecordBatch.from_arrays([pa.array([_record(b"HBLK", rest)], pa.binary())], ["value"])

        for batch in batches:
            for part in chunks(batch, "payload", BLOCK_BYTES):
                if start is None:
                    start = int(starts[part.column("bucket")[0].as_py()])
                    head = _record(b"HCOD", zlib.compress(lengths.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary())], ["value"])
                held.append(part)
                size += part.column("payload").nbytes
                if size >= BLOCK_BYTES:
                    yield block()
                    start += sum(int(pa.compute.sum(p.column("n_tokens")).as_py()) for p in held)
                    held, size = [], 0
        if held:
            yield block()

    coded = table.mapInArrow(code, "doc_id bigint, tie bigint, n_tokens bigint, bucket int, payload binary, marks binary")
    # Null ids come first in ascending order, as their ranges do.
    ordered = coded.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("doc_id", "tie")
    write_records(ordered.mapInArrow(blocks, "value binary"), path, MARK)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _read_file(memoryview(content.as_buffer()), with_ids)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return read_files(spark, path).select("content").mapInArrow(run, schema)


def _read_file(data: memoryview, with_ids: bool) -> Iterator[pa.RecordBatch]:
    at, table = 0, None
    while at < len(data):
        kind, size = bytes(data[at : at + 4]), struct.unpack_from("<Q", data, at + 4)[0]
        rest = data[at + 12 : at + 12 + size]
        at += 12 + size
        if bytes(data[at : at + len(MARK)]) != MARK:
            raise ValueError("a record does not end in the mark")
        at += len(MARK)
        if kind == b"HCOD":
            table = decoding_table(np.frombuffer(zlib.decompress(rest), np.uint8))
            continue
        n_docs, start = struct.unpack_from("<QQ", rest)
        to = 16

        def array(dtype, n):
            nonlocal to
            out = np.frombuffer(rest, dtype, n, to)
            to += out.nbytes
            return out

        ids, present = array("<i8", n_docs), array("u1", n_docs)
        counts, sizes = array("<u8", n_docs).astype(np.int64), array("<u8", n_docs).astype(np.int64)
        marks = array("<u4", int(np.maximum(0, (counts - 1) // CHECKPOINT).sum())).astype(np.int64)
        tokens = unpack(bytes(rest[to:]), np.cumsum(sizes) - sizes, counts, marks, table).astype("<u4")
        ends = np.cumsum(counts)
        sums = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
        columns = [pa.array(ids, mask=present == 0), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
            columns.append(pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)]))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)
