r"""Pieces of text before the merges of a byte-level BPE, found with numpy on whole batches.

The split is that of the pattern of the public rank files,
``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``:
runs of letters, numbers, white space or other characters, a space joining the run after it.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

from casegrid.llm.bytetext import Texts

LETTER, NUMBER, OTHER, WHITE = range(4)
# Fixed value: the endings that follow an apostrophe in the pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the library's own regular expressions see it.

    Python's Unicode tables are older. The tokenizers library has the same letters and numbers.
    """
    import tiktoken

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    # Planes 4 to 13 are not in use, and 15 and 16 are private: no letter, number or space is there.
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000))))
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte at which each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    value = lead.copy()
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        some = np.flatnonzero(lead >= low) if size == 4 else np.flatnonzero((lead >= low) & (lead < (low | (low >> 1)) & 0xFF))
        if len(some):
            v = lead[some] & mask
            for k in range(1, size):
                v = (v << 6) | (padded[at[some] + k] & 0x3F)
            value[some] = v
    return np.minimum(value, sys.maxunicode), at


def split(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces (with the end of the data) and the number of pieces of each text."""
    data = texts.data
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    point, at = code_points(data)
    kind = classes()[point]
    n = len(kind)
    bounds = np.searchsorted(at, texts.offsets)  # texts in characters
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    last = first[1:]  # the last character of a text
    change = first[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    # White space before something else in the same text: its last character stands apart, and a
    # space joins what follows.
    tail = np.zeros(n, bool)
    tail[:-1] = (kind[:-1] == WHITE) & (kind[1:] != WHITE)
    tail &= ~last
    start |= tail
    joined = np.flatnonzero(tail & (point == 32)) + 1
    start[joined] = False
    # Contractions at the start of a piece.
    for quote in [np.flatnonzero((point == 39) & start)]:
        for ending in ENDINGS:
            size = len(ending)
            q = quote[quote + size < n]
            fits = np.ones(len(q), bool)
            for k, letter in enumerate(ending, 1):
                fits &= (point[q + k] == ord(letter)) & ~first[q + k]
            q = q[fits]
            start[q + 1] = False
            after = q + size + 1
            after = after[after < n]
            after = after[~(first[after])]
            # What follows starts a piece: also the rest of the letters.
            start[after] = True
    begins = at[start]
    counts = np.diff(np.searchsorted(begins, texts.offsets))
    return np.concatenate([begins, [len(data)]]), counts
