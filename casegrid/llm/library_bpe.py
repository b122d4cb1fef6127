"""Token ids from the tokenizers library, every distinct piece of text encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from casegrid.llm.bytetext import RollingHash, Texts
from casegrid.llm.memo import Memo, distinct
from casegrid.llm.pieces import split

# Distinct pieces a worker remembers before it starts anew.
MAX_PIECES = 400_000


class PieceEncoder:
    """Encodes whole texts with a ``tokenizers.Tokenizer`` whose pre-tokenizer is the byte-level split.

    That split makes the pieces of a text independent of each other, so the library need see each
    distinct piece only once, as one word of a text that is split already. Pieces are told apart by
    64-bit hashes.

    With ``added_tokens`` the file's added tokens are found in texts, as the library does by default;
    without, they are ordinary text.
    """

    def __init__(self, path: str, max_pieces: int = MAX_PIECES, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added, self._literals = {}, None
        if added_tokens:
            tokens = self._tokenizer.get_added_tokens_decoder()
            if any(t.single_word or t.lstrip or t.rstrip for t in tokens.values()) or self._tokenizer.normalizer is not None:
                raise ValueError("added tokens that depend on what is around them")
            self._added = {t.content.encode(): i for i, t in tokens.items()}
            # The longest of those that begin at one place, as the library takes it.
            if self._added:
                self._literals = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True))))
        # Pieces are cut between the added tokens and hold none.
        self._tokenizer.encode_special_tokens = True
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        # Bytes of every token: one character of its byte-level form stands for one byte.
        self._bytes = np.zeros(self.size, np.int64)
        for token, i in self._tokenizer.get_vocab(with_added_tokens=False).items():
            self._bytes[i] = len(token)
        self._memo = Memo(max_pieces)

    def _learn(self, keys: np.ndarray, pieces: list[str], sizes: np.ndarray) -> np.ndarray:
        """Entries of new pieces of these sizes in bytes, all encoded in one call."""
        found = self._tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids
        ids = np.array(found, np.uint32)
        # Tokens cover the bytes of pieces without a gap, so lengths tell which are whose.
        ends = np.cumsum(self._bytes[ids])
        last = np.searchsorted(ends, np.cumsum(sizes))
        if len(last) and (last[-1] + 1 != len(ids) or not np.array_equal(ends[last], np.cumsum(sizes))):
            raise ValueError("tokens that do not cover the bytes of their texts")
        return self._memo.add(keys, ids, np.diff(last, prepend=-1))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        raw = texts.data.tobytes() if self._literals else b""
        if not self._literals or not self._literals.search(raw):
            return self._encode_pieces(texts)
        bounds = enumerate(zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist()))
        found = [(i, m.end(), len(m[0]), self._added[m[0]]) for i, (a, b) in bounds for m in self._literals.finditer(raw, a, b)]
        owner, end, size, added = np.array(found, np.int64).reshape(-1, 4).T
        # A part begins with each text and behind each token; the bytes of tokens are taken out.
        n = len(texts)
        owners, begins = np.concatenate([np.arange(n), owner]), np.concatenate([texts.offsets[:-1], end])
        order = np.lexsort((begins, owners))
        owners, token = owners[order], np.concatenate([np.full(n, -1), added])[order]
        gone = np.cumsum(np.concatenate([np.zeros(n, np.int64), size])[order])
        inside = np.zeros(len(raw) + 1, np.int64)
        np.add.at(inside, end - size, 1)
        np.add.at(inside, end, -1)
        parts = Texts.__new__(Texts)
        parts.data = texts.data[np.cumsum(inside[:-1]) == 0]
        parts.offsets = np.concatenate([begins[order] - gone, [len(parts.data)]])
        parts.null = np.zeros(len(owners), bool)
        ids, counts = self._encode_pieces(parts)
        before = token >= 0
        ids = np.insert(ids, (np.cumsum(counts) - counts)[before], token[before].astype(np.uint32))
        return ids, np.bincount(owners, weights=counts + before, minlength=n).astype(np.int64)

    def _encode_pieces(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        if self._memo.full:
            self._memo.clear()
        bounds, counts = split(texts)
        keys, first, inverse = distinct(RollingHash(texts.data).spans(bounds[:-1], bounds[1:]))
        entries = self._memo.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            raw = texts.data.tobytes()
            begin, end = bounds[first[new]], bounds[first[new] + 1]
            pieces = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]
            entries[new] = self._learn(keys[new], pieces, end - begin)
        ids, made = self._memo.gather(entries[inverse])
        ends = np.concatenate([[0], np.cumsum(made)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=1)
def piece_encoder(path: str, added_tokens: bool = False) -> PieceEncoder:
    """One encoder for a worker process."""
    return PieceEncoder(path, added_tokens=added_tokens)
