"""Whole texts of an Arrow batch as one byte array, with words and 64-bit rolling hashes in numpy.

A hash of the bytes ``s..e`` is the difference of two prefix sums of ``value[byte] * R**position``,
divided by ``R**s``, modulo 2**64, so that any number of spans costs one pass over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

# Bytes of text handled at once inside a task; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
# Most texts of a chunk, however short they are: their numbers share 64-bit words with other values.
CHUNK_ROWS = 1000

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1 << 62, 1 << 63, 256, dtype=np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    for _ in range(bits):
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out


class RollingHash:
    """Prefix sums over ``data``; ``spans(starts, ends)`` hashes any spans.

    ``data`` are bytes, or numbers below the length of ``values``.
    """

    def __init__(self, data: np.ndarray, values: np.ndarray = _VALUES):
        bits = max(int(CHUNK_BYTES).bit_length(), int(len(data)).bit_length())
        self._inverse = _powers(bits, _R_INVERSE)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _powers(bits, _R)[: len(data)], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])


class Texts:
    """Texts ``i`` at ``data[offsets[i]:offsets[i + 1]]``; a null text is empty and noted in ``null``."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.null = column.is_null().to_numpy(zero_copy_only=False)
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        first = int(at[0])
        self.data = np.frombuffer(data, np.uint8, int(at[-1]) - first, first) if data else np.zeros(0, np.uint8)
        self.offsets = at - first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs of bytes that are not ASCII white space."""
        data = self.data if data is None else data
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts, ends and text numbers of the pieces between ``\n`` (every text has one at least)."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        owner = np.searchsorted(self.offsets, breaks, "right") - 1
        text = np.concatenate([np.arange(len(self)), owner])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = ends[np.lexsort((ends, np.concatenate([np.arange(len(self)), owner])))]
        return starts, ends, text

    def per_text(self, flags: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Sum of ``flags`` for every text."""
        return np.bincount(texts, weights=flags, minlength=len(self)).astype(np.int64)


def windows(values: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of one text, and the positions of their first words."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(values) - n + 1, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * _R % (1 << 64)
        total += values[k : len(values) - n + 1 + k] * np.uint64(factor)
    inside = np.flatnonzero(texts[: len(total)] == texts[n - 1 :])
    return mix(total[inside]), inside


def chunks(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` hold about ``limit`` bytes, of ``CHUNK_ROWS`` texts at most."""
    if not batch.num_rows:
        return
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths.astype(np.int64)) - lengths) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    cuts = np.union1d(cuts, np.arange(CHUNK_ROWS, batch.num_rows, CHUNK_ROWS))
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [batch.num_rows]])):
        yield batch.slice(int(a), int(b - a))


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once?"""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values
