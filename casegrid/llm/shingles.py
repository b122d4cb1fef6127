"""Distinct word shingles of whole texts, as sorted 52-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

from casegrid.llm.bytetext import LOWER, RollingHash, Texts, mix, windows

BITS = 52  # of a shingle's hash; the number of its text within a chunk sits above them
_MASK = np.uint64((1 << BITS) - 1)
SHINGLE = 5


class Sets:
    """The sets of a chunk of texts: those of text ``i`` are ``values[bounds[i]:bounds[i + 1]]``, ascending."""

    def __init__(self, texts: Texts, size: int = SHINGLE):
        if len(texts) >= 1 << (63 - BITS):
            raise ValueError("too many texts in one chunk")
        data = LOWER[texts.data]
        starts, ends, owner = texts.words(data)
        words = RollingHash(data).spans(starts, ends)
        values, at = windows(words, owner, size)
        found = [(values, owner[at])]
        n_words = np.bincount(owner, minlength=len(texts))
        # A shorter text is one shingle: all its words.
        for n in range(1, size):
            short = np.flatnonzero(n_words[owner] == n) if len(owner) else np.zeros(0, np.int64)
            if len(short):
                values, at = windows(words[short], owner[short], n)
                found.append((values, owner[short][at]))
        keys = np.concatenate([(t.astype(np.uint64) << np.uint64(BITS)) | (v & _MASK) for v, t in found])
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        self.owner = (keys >> np.uint64(BITS)).astype(np.int64)
        self.values = (keys & _MASK).astype(np.int64)
        self.sizes = np.bincount(self.owner, minlength=len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    def names(self) -> np.ndarray:
        """A 63-bit name of every set that does not depend on anything but its members."""
        spread = mix(self.values.astype(np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
        total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        return (mix(total ^ mix(self.sizes.astype(np.uint64))) >> np.uint64(1)).astype(np.int64)
