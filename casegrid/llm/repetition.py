"""Repetition coverage: characters inside duplicated n-grams and lines, by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.bytetext import RollingHash, Texts, chunks, mix, repeated, windows

# Largest share of a text's word characters inside duplicated n-grams, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHARS_LIMIT = 0.20
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, dup_line_chars bigint, "
    + ", ".join(f"dup_{n}gram_chars bigint" for n in NGRAM_LIMITS)
)


def _covered(flags: np.ndarray, positions: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any flagged window of ``n`` words."""
    if not flags.any():
        return np.zeros(total, bool)
    first = positions[flags]
    return np.cumsum(np.bincount(first, minlength=total + 1) - np.bincount(first + n, minlength=total + 1))[:-1] > 0


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one?"""
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return later


def measure(texts: Texts, ngrams: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """The measures of every text. Characters are code points; hashes have 64 bits."""
    starts, ends, owner = texts.words()
    hashes = RollingHash(texts.data)
    points = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    salt = mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    words = hashes.spans(starts, ends)
    symbols = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_SYMBOL[texts.data], out=symbols[1:])
    out = {
        "n_words": np.bincount(owner, minlength=len(texts)),
        "word_chars": texts.per_text(chars, owner),
        "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]],
    }
    # Lines: those with a word that equal an earlier line of the same text.
    l_starts, l_ends, l_owner = texts.lines()
    in_line = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    l_starts, l_ends, l_owner = l_starts[in_line], l_ends[in_line], l_owner[in_line]
    keys = hashes.spans(l_starts, l_ends) ^ salt[l_owner]
    later = _later(keys)
    out["n_lines"] = np.bincount(l_owner, minlength=len(texts))
    out["n_dup_lines"] = texts.per_text(later, l_owner)
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = char_sums[np.searchsorted(starts, l_ends)] - char_sums[np.searchsorted(starts, l_starts)]
    out["dup_line_chars"] = texts.per_text(np.where(later, line_chars, 0), l_owner)
    # Windows found twice or more; a window of n + 1 words can only repeat where its first n words do.
    values, at = windows(words, owner, 3)
    twice = repeated(values ^ salt[owner[at]])
    out["n_repeat_words"] = texts.per_text(_covered(twice, at, 3, len(words)), owner)
    possible = np.zeros(len(words) + 1, bool)
    possible[at[twice]] = True
    for n in ngrams:
        values, at = windows(words, owner, n)
        some = possible[at]
        values, at = values[some], at[some]
        keys = values ^ salt[owner[at]]
        twice = repeated(keys)
        at, keys = at[twice], keys[twice]
        out[f"dup_{n}gram_chars"] = texts.per_text(np.where(_covered(_later(keys), at, n, len(words)), chars, 0), owner)
        possible[:] = False
        possible[at] = True
    return out


def repetition_coverage(
    docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT,
    line_chars_limit: float = LINE_CHARS_LIMIT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Measures and verdict per row of ``docs(doc_id, text)``; other columns are not read.

    ``kept`` is false for texts under ``min_words`` words, for texts with more than half of their
    words in repeated 3-word windows, and beyond any of the limits on characters inside duplicated
    n-grams (n ascending, from 3) and lines. Both count the later occurrences, not the first, so that
    one repeated header does not weigh twice. A null text counts as empty. Rows with equal or null
    ids are measured one by one. An empty table gives no rows.
    """
    limits = dict(sorted((ngram_limits or NGRAM_LIMITS).items()))
    if min(limits) < 3:
        raise ValueError("n-gram lengths start at 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                m = measure(Texts(part.column("text")), tuple(limits))
                m["base_failed"] = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                failed = m["base_failed"] | (m["n_dup_lines"] > line_limit * m["n_lines"])
                failed |= m["dup_line_chars"] > line_chars_limit * m["word_chars"]
                for n, limit in limits.items():
                    failed |= m[f"dup_{n}gram_chars"] > limit * m["word_chars"]
                m["kept"] = ~failed
                arrays = [part.column("doc_id")] + [pa.array(m[c]) for c in names[1:]]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = SCHEMA.split(", dup_5gram_chars")[0] + "".join(f", dup_{n}gram_chars bigint" for n in limits)
    names = [c.split()[0] for c in schema.split(",")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
