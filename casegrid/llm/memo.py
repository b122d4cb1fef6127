"""Values remembered by 64-bit key inside a worker, found for whole arrays of keys at once."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLOTS = 1 << 21
# Seconds without a task after which a worker drops what it has kept; tasks of one stage follow each other at once.
IDLE_SECONDS = 3.0

_KEPT: list[Callable] = []
_WAITING: list[threading.Timer] = []
# Gives freed memory back to the system, which the C library does not do by itself; absent from some libraries.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def kept(make: Callable) -> Callable:
    """``make`` with its last results kept for the next task of the worker, until ``forget``."""
    _KEPT.append(lru_cache(maxsize=2)(make))
    return _KEPT[-1]


def release() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task holds on to it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def forget() -> None:
    """Drop what other operators have kept: Spark reuses workers, and an executor's memory is for the one at work."""
    for make in _KEPT:
        make.cache_clear()
    release()


def _wait(start: bool) -> None:
    """Start to wait for the next task, or stop."""
    while _WAITING:
        _WAITING.pop().cancel()
    if start:
        _WAITING.append(threading.Timer(IDLE_SECONDS, forget))
        _WAITING[-1].daemon = True
        _WAITING[-1].start()


def lean(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that leaves its worker small.

    With ``keep``, what is ``kept`` serves the tasks that begin within ``IDLE_SECONDS``.
    """

    def inner(batches: Iterator) -> Iterator:
        _wait(False)
        if not keep:
            forget()
        try:
            yield from run(batches)
        finally:
            release()
            _wait(keep)

    return inner


class Memo:
    """Arrays of integers by key: entry ``e`` is ``values[begin[e]:begin[e] + count[e]]``.

    Entries are appended; two tables of slots lead from a key to its entry. A key whose slots are
    taken replaces another one, which is then learnt again when it comes: results never depend on it.
    ``full`` says when more than ``limit`` entries or eight times as many values are held; the caller
    then clears the memo between two batches, as entry numbers of a batch have to stay valid.
    """

    def __init__(self, limit: int, dtype=np.uint32):
        self._limit, self._dtype = limit, dtype
        self.clear()

    def clear(self) -> None:
        self._slots = np.full((2, SLOTS), -1, np.int32)
        self.entries = self.held = 0
        self._room(1 << 16, 1 << 18)

    def _room(self, entries: int, values: int) -> None:
        """Arrays of at least these lengths, with what they held."""
        keys, begin, count = np.zeros(entries, np.uint64), np.zeros(entries, np.int64), np.zeros(entries, np.int64)
        store = np.zeros(values, self._dtype)
        if self.entries:
            for new, was in ((keys, self.keys), (begin, self.begin), (count, self.count)):
                new[: self.entries] = was[: self.entries]
            store[: self.held] = self.values[: self.held]
        self.keys, self.begin, self.count, self.values = keys, begin, count, store

    @property
    def full(self) -> bool:
        return self.entries > self._limit or self.held > 8 * self._limit

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(SLOTS - 1)
        return keys & mask, (keys >> np.uint64(32)) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 for those not held."""
        first, second = self._places(keys)
        at = self._slots[0][first]
        at = np.where((at >= 0) & (self.keys[at] == keys), at, -1)
        missing = np.flatnonzero(at < 0)
        other = self._slots[1][second[missing]]
        at[missing] = np.where((other >= 0) & (self.keys[other] == keys[missing]), other, -1)
        return at

    def add(self, keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Entries of new and distinct keys; the values of all follow each other."""
        n, size = len(keys), len(values)
        if self.entries + n > len(self.keys) or self.held + size > len(self.values):
            self._room(2 * (self.entries + n), 2 * (self.held + size))
        new = np.arange(self.entries, self.entries + n)
        self.keys[new], self.count[new] = keys, counts
        self.begin[new] = self.held + np.cumsum(counts) - counts
        self.values[self.held : self.held + size] = values
        self.entries, self.held = self.entries + n, self.held + size
        first, second = self._places(keys)
        taken = self._slots[0][first] >= 0
        self._slots[0][first[~taken]] = new[~taken]
        # Of new keys with one slot the last has got it; the others go to the second table as well.
        lost = self._slots[0][first] != new
        self._slots[1][second[lost]] = new[lost]
        return new

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all these entries in order, and how many each has."""
        made = self.count[entries]
        total = np.cumsum(made)
        if not len(total) or not total[-1]:
            return np.zeros(0, self._dtype), made
        return self.values[np.repeat(self.begin[entries] - (total - made), made) + np.arange(total[-1])], made


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one of each, and which of them every key is."""
    return np.unique(keys, return_index=True, return_inverse=True)
