"""Byte-level BPE as a finite-state transducer that is determinised while it runs.

A sequence of tokens is the BPE encoding of its bytes exactly if every token encodes to itself and
every two neighbours encode, together, to those two tokens: merges never cross a boundary between
tokens unless they cross it for the two neighbours alone. So a nondeterministic transducer need only
remember the last token and the place in the trie of tokens where the next one has got to.

The deterministic state is the set of such configurations, each with the tokens it has not yet
agreed on with the others. A byte advances all of them; tokens that all agree on are emitted, so the
output lags the input by the few bytes until competing tokens are decided. States and transitions
are built when first met and kept in tables, through which numpy runs all pieces of a batch in step.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.bytetext import Texts, chunks
from casegrid.llm.memo import kept, lean, release
from casegrid.llm.pieces import split

END = 256  # the input symbol after the last byte of a piece
# Rows of the transition table; a machine that has more states starts anew with those in use.
MAX_STATES = 250_000
# Pairs of tokens whose answer is remembered; beyond, all are asked anew.
MAX_PAIRS = 1 << 16

# Before a piece: at the root of the trie, no last token, nothing held.
START = ((0, -1, ()),)
# Fewer pieces than this are walked one by one.
FEW = 16

# The largest pieces of text and id lists handled at once: arrays of some 100 bytes for each byte of text.
RUN_BYTES = 1 << 18
DECODE_IDS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merges:
    """The ranks, with the two questions that the transducer asks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._kept: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def merge(self, data: bytes, until: int = 1, boundary: int = -1) -> list[int] | None:
        """Bounds of the tokens of ``data``, merged until ``until`` are left; None as soon as a merge
        crosses ``boundary``."""
        at = list(range(len(data) + 1))
        ranks = self.ranks
        pairs = [ranks.get(data[i : i + 2], -1) for i in range(len(data) - 1)]
        while len(at) - 1 > until:
            best, k = 1 << 60, -1
            for i, rank in enumerate(pairs):
                if 0 <= rank < best:
                    best, k = rank, i
            if k < 0:
                return at
            if at[k + 1] == boundary:
                return None
            del at[k + 1], pairs[k]
            if k:
                pairs[k - 1] = ranks.get(data[at[k - 1] : at[k + 1]], -1)
            if k < len(pairs):
                pairs[k] = ranks.get(data[at[k] : at[k + 2]], -1)
        return at

    def keeps(self, token: int) -> bool:
        """Does the token encode to itself?"""
        known = self._kept.get(token)
        if known is None:
            known = self._kept[token] = len(self.merge(self.tokens[token])) == 2
        return known

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]] | None:
        """The parts at one edge of a token (0 left, 1 right) as its merges go on, smallest first, each
        with the rank of the merge that ends it. None where a part has a larger rank than the whole,
        so that merges may not go by rank."""
        known = self._spines[side].get(token, 0)
        if known != 0:
            return known
        if len(token) == 1:
            spine = [(token, 1 << 60)]
        else:
            if token not in self._halves:
                at = self.merge(token, 2)
                left, right = token[: at[1]], token[at[1] :]
                rank = self.ranks[token]
                orderly = len(at) == 3 and all(len(x) == 1 or self.ranks.get(x, 1 << 60) < rank for x in (left, right))
                self._halves[token] = (left, right) if orderly else None
            halves = self._halves[token]
            inner = self._spine(halves[side], side) if halves and self._spine(halves[1 - side], side) is not None else None
            spine = inner and inner[:-1] + [(inner[-1][0], self.ranks[token]), (token, 1 << 60)]
        self._spines[side][token] = spine
        return spine

    def fit(self, left: int, right: int) -> bool:
        """Do two tokens encode, together, to these two?"""
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[pair] = self._fit(self.tokens[left], self.tokens[right])
        return known

    def _fit(self, left: bytes, right: bytes) -> bool:
        """Walk the edges that face each other in the order of their merges, and see whether a merge of
        the two edges would come before either goes on."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        if a is None or b is None:
            return self.merge(left + right, 1, len(left)) is not None
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            rank = self.ranks.get(x + y, 1 << 60)
            if rank < x_ends and rank <= y_ends:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


class Steps:
    """Numbers of the transitions learnt, by state and symbol: a hash table, as a state has few of them."""

    def __init__(self, slots: int = 1 << 12):
        self._held = 0
        self._keys, self._steps = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self._keys).bit_length())).astype(np.int64)

    def find(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The step of each, -1 where it is not learnt yet."""
        keys = (states.astype(np.int64) << 9) | symbols
        slots = self._slots(keys)
        there = self._keys[slots]
        out = np.where(there == keys, self._steps[slots], -1)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slots[more] = (slots[more] + 1) & (len(self._keys) - 1)
            there = self._keys[slots[more]]
            hit = there == keys[more]
            out[more[hit]] = self._steps[slots[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def _slot(self, key: int) -> int:
        """The slot that holds the key, or the free one where it belongs."""
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (65 - len(self._keys).bit_length())
        while (there := self._keys.item(slot)) >= 0 and there != key:
            slot = (slot + 1) & (len(self._keys) - 1)
        return slot

    def get(self, state: int, symbol: int) -> int:
        """The step, -1 where it is not learnt yet."""
        slot = self._slot((state << 9) | symbol)
        return self._steps.item(slot) if self._keys.item(slot) >= 0 else -1

    def add(self, state: int, symbol: int, step: int) -> None:
        if 2 * (self._held + 1) > len(self._keys):
            keys, steps = self._keys[self._keys >= 0], self._steps[self._keys >= 0]
            self.__init__(2 * len(self._keys))
            self._place(keys, steps)
        key = (state << 9) | symbol
        slot = self._slot(key)
        self._keys[slot], self._steps[slot] = key, step
        self._held += 1

    def _place(self, keys: np.ndarray, steps: np.ndarray) -> None:
        """Put new and distinct keys into the next free slots."""
        self._held += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self._keys[slots] < 0)
            self._keys[slots[free]] = keys[free]
            placed = self._keys[slots] == keys
            self._steps[slots[placed]] = steps[placed]
            keys, steps, slots = keys[~placed], steps[~placed], (slots[~placed] + 1) & (len(self._keys) - 1)


def _packed_state(key: tuple) -> bytes:
    """A state's configurations as 32-bit integers: a worker keeps very many of them."""
    flat = array("i")
    for node, last, held in key:
        flat.extend((node, last, len(held)))
        flat.extend(held)
    return flat.tobytes()


def _unpacked_state(data: bytes) -> tuple:
    flat, at, key = memoryview(data).cast("i").tolist(), 0, []
    while at < len(flat):
        end = at + 3 + flat[at + 2]
        key.append((flat[at], flat[at + 1], tuple(flat[at + 3 : end])))
        at = end
    return tuple(key)


class Transducer:
    """Lazily determinised; ``run`` encodes many pieces at once."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.merges = Merges(ranks)
        self.max_states = max_states
        # The trie in flat arrays: nodes by depth, then bytes, so that the children of node i are the nodes
        # children[i]..children[i + 1], and labels has the last byte of each node.
        nodes = sorted({token[:k] for token in ranks for k in range(len(token) + 1)}, key=lambda x: (len(x), x))
        self._labels = bytes(x[-1] if x else 0 for x in nodes)
        self._token = array("i", (ranks.get(x, -1) for x in nodes))
        below = Counter(x[:-1] for x in nodes if x)
        self._children = array("i", itertools.accumulate((below[x] for x in nodes), initial=1))
        self._clear()

    def _clear(self) -> None:
        # A configuration: (trie node, last token or -1, tokens not yet emitted); a state has several, packed.
        self._states: dict[bytes, int] = {}
        self._keys: list[bytes] = []
        self._steps = Steps()
        self._next = np.zeros(1024, np.int32)
        # Tokens of the transitions learnt since the arrays of all others were made.
        self._out: list[tuple[int, ...]] = []
        self._out_arrays = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self._intern(_packed_state(START))

    def _intern(self, key: bytes) -> int:
        number = self._states.get(key)
        if number is None:
            number = self._states[key] = len(self._keys)
            self._keys.append(key)
        return number

    def _advance(self, key: tuple, symbol: int) -> tuple[tuple, tuple[int, ...]]:
        """The next state and the tokens emitted on the way."""
        if symbol == END:
            for node, last, held in key:  # a piece that is itself a token is that token
                if last == -1 and node and self._token[node] >= 0:
                    return START, (self._token[node],)
            for node, _, held in key:
                if node == 0:
                    return START, held
            raise ValueError("the ranks do not cover all bytes")
        # Oldest place first, so that equal sets are equal tuples.
        grown, new = [], None
        merges, labels, children = self.merges, self._labels, self._children
        for node, last, held in key:
            child = labels.find(symbol, children[node], children[node + 1])
            if child < 0:
                continue
            token = self._token[child]
            if token >= 0 and merges.keeps(token) and (last < 0 or merges.fit(last, token)):
                new = (0, token, held + (token,))
            if children[child] < children[child + 1] or (last < 0 and token >= 0):
                grown.append((child, last, held))
        if new:
            grown.append(new)
        if not grown:
            raise ValueError("the ranks do not cover all bytes")
        first = grown[0][2]
        agreed = len(first)
        for _, _, held in grown:
            while held[:agreed] != first[:agreed]:
                agreed -= 1
        if not agreed:
            return tuple(grown), ()
        return tuple([(node, last, held[agreed:]) for node, last, held in grown]), first[:agreed]

    def _learn(self, state: int, symbol: int) -> int:
        key, out = self._advance(_unpacked_state(self._keys[state]), symbol)
        number = self._intern(_packed_state(key))
        step = len(self._out_arrays[1]) + len(self._out)
        if step == len(self._next):
            self._next = np.concatenate([self._next, np.zeros_like(self._next)])
        self._next[step] = number
        self._out.append(out)
        self._steps.add(state, symbol, step)
        return step

    def _outputs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all transitions, with where each transition's begin and how many they are."""
        if self._out:
            sizes = np.fromiter(map(len, self._out), np.int32, len(self._out))
            flat = np.fromiter((t for out in self._out for t in out), np.uint32, int(sizes.sum()))
            flat, sizes = np.concatenate([self._out_arrays[0], flat]), np.concatenate([self._out_arrays[1], sizes])
            self._out_arrays = (flat, sizes, np.cumsum(sizes, dtype=np.int64) - sizes)
            self._out = []
        return self._out_arrays

    def _walk(self, state: int, data: np.ndarray, steps: np.ndarray, place: int) -> None:
        """The rest of one piece, byte by byte."""
        for symbol in [*data.tolist(), END]:
            step = self._steps.get(state, symbol)
            if step < 0:
                step = self._learn(state, symbol)
            steps[place] = step
            place += 1
            state = self._next.item(step)
            if len(self._keys) > 2 * self.max_states:
                (state,) = self._shrink([int(state)])

    def _shrink(self, states: list[int]) -> list[int]:
        """Forget all states but these; transitions taken keep their numbers until the run is over."""
        keys = [self._keys[s] for s in states]
        self._states, self._keys = {}, []
        self._steps = Steps()
        self._intern(_packed_state(START))
        return [self._intern(key) for key in keys]

    def run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``data[bounds[i]:bounds[i + 1]]`` in order, and the number of ids of each piece."""
        if len(self._keys) > self.max_states:
            self._clear()
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        begins, sizes = bounds[:-1][order], lengths[order]
        # One place for every byte and for the end of every piece.
        places = begins + order
        steps = np.zeros(len(data) + len(lengths), np.int32)
        state = np.zeros(len(order), np.int32)
        alive = len(order)
        for k in range(int(sizes[0]) + 1 if alive else 0):
            alive = int(np.searchsorted(-sizes, -k, "right"))  # pieces with k bytes or more
            going = int(np.searchsorted(-sizes, -k, "left"))  # pieces with more than k bytes
            if going < FEW:
                for i, key in enumerate([self._keys[s] for s in state[:alive]]):
                    self._walk(self._intern(key), data[begins[i] + k : begins[i] + sizes[i]], steps, int(places[i]) + k)
                break
            symbol = np.full(alive, END, np.int32)
            symbol[:going] = data[begins[:going] + k]
            now = state[:alive]
            step = self._steps.find(now, symbol)
            unknown = np.flatnonzero(step < 0)
            if len(unknown):
                for s, b in set(zip(now[unknown].tolist(), symbol[unknown].tolist())):
                    self._learn(s, b)
                step[unknown] = self._steps.find(now[unknown], symbol[unknown])
            steps[places[:alive] + k] = step
            state[:alive] = self._next[step]
            if len(self._keys) > 2 * self.max_states:
                state[:alive] = self._shrink(state[:alive].tolist())
        flat, count, offset = self._outputs()
        made = count[steps].astype(np.int64)
        ids = np.zeros(0, np.uint32)
        total = np.cumsum(made)
        if len(total) and total[-1]:
            at = np.repeat(offset[steps] - (total - made), made) + np.arange(total[-1])
            ids = flat[at]
        ends = np.concatenate([[0], total])[bounds[1:] + np.arange(1, len(bounds))]
        return ids, np.diff(np.concatenate([[0], ends]))


@kept
def transducer(path: str) -> Transducer:
    """One machine for a worker process: what it has learnt serves the next task."""
    return Transducer(load_ranks(path))


def encode(texts: Texts, machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids of each text."""
    bounds, counts = split(texts)
    ids, made = [], []
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + RUN_BYTES, "right")) - 1)
        part = bounds[at : to + 1]
        got, each = machine.run(texts.data[part[0] : part[-1]], part - part[0])
        ids.append(got)
        made.append(each)
        at = to
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    made = np.concatenate([[0], np.cumsum(np.concatenate(made) if made else np.zeros(0, np.int64))])
    return ids, np.diff(made[np.concatenate([[0], np.cumsum(counts)])])


class Utf8Machine:
    """UTF-8 one byte at a time: which bytes may come next, and whether a character is complete.

    The state is ``(bytes still due, least next byte, largest next byte)``.
    """

    READY = (0, 0, 0)

    @staticmethod
    def step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
        """The next state; None where the byte cannot follow."""
        due, low, high = state
        if due:
            return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
        if byte < 0x80:
            return Utf8Machine.READY
        if 0xC2 <= byte <= 0xDF:
            return (1, 0x80, 0xBF)
        if 0xE0 <= byte <= 0xEF:
            return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
        if 0xF0 <= byte <= 0xF4:
            return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
        return None


class StreamDecoder:
    """Text from chunks of ids; the bytes of an unfinished character wait for the next chunk."""

    def __init__(self, vocabulary: tuple[np.ndarray, np.ndarray]):
        self._bytes, self._offsets = vocabulary
        self._held = b""

    def bytes_of(self, ids: np.ndarray) -> bytes:
        begins, sizes = self._offsets[ids], np.diff(self._offsets)[ids]
        total = np.cumsum(sizes)
        if not len(total):
            return b""
        return self._bytes[np.repeat(begins - (total - sizes), sizes) + np.arange(total[-1])].tobytes()

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        """The text that is complete; bytes that are no UTF-8 become U+FFFD."""
        data = self._held + self.bytes_of(ids)
        cut = len(data)
        if not last:
            # An unfinished character can only begin in the last three bytes.
            for begin in range(max(0, cut - 3), cut):
                state = Utf8Machine.READY
                for byte in data[begin:]:
                    state = Utf8Machine.step(state, byte)
                    if state is None or state == Utf8Machine.READY:
                        break
                if state is not None and state[0] > 0:
                    cut = begin
                    break
        self._held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


@kept
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens and their offsets by id; ids that the file leaves out are empty."""
    tokens = {i: t for t, i in load_ranks(path).items()}
    parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def decode_stream(ids: np.ndarray, vocab: tuple[np.ndarray, np.ndarray], step: int = DECODE_IDS) -> Iterator[str]:
    decoder = StreamDecoder(vocab)
    for at in range(0, max(1, len(ids)), step):
        yield decoder.feed(ids[at : at + step], last=at + step >= len(ids))


def encode_documents(docs: DataFrame, ranks_path: str, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text.

    ``ranks_path`` is a rank file that every executor can open. A null text is empty and has no ids.
    Every row is encoded by itself, so repeated rows and null ids do no harm.
    """
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(ranks_path)
        for batch in batches:
            for part in chunks(batch, "text", RUN_BYTES):
                ids, counts = encode(Texts(part.column("text")), machine)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [packed(ids, counts)], [*keep, "ids"])
            release()

    selected = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f for f in selected.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return selected.mapInArrow(lean(run, keep=True), f"{schema}, ids binary")


def packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value of unsigned 32-bit integers per text."""
    offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    data = np.ascontiguousarray(ids, dtype="<u4")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, round_trip boolean"


def encode_and_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every text, decode the ids as a stream, and return digests of both per row.

    ``round_trip`` tells whether the decoded text is the input. A null text counts as empty. Rows
    with equal or null ids are handled one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, vocab = transducer(ranks_path), vocabulary(ranks_path)
        decimals = np.array([str(i) for i in range(len(vocab[1]) - 1)], dtype=object)
        for batch in batches:
            for part in chunks(batch, "text", RUN_BYTES):
                texts = Texts(part.column("text"))
                ids, counts = encode(texts, machine)
                ends = np.cumsum(counts)
                raw = texts.data.tobytes()
                rows = []
                for k, (to, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                    own = ids[to - n : to]
                    back, size = hashlib.sha256(), 0
                    source = raw[texts.offsets[k] : texts.offsets[k + 1]]
                    same = True
                    for piece in decode_stream(own, vocab):
                        piece = piece.encode()
                        back.update(piece)
                        same = same and source[size : size + len(piece)] == piece
                        size += len(piece)
                    rows.append((
                        n, hashlib.sha256(",".join(decimals[own]).encode()).hexdigest(), back.hexdigest(), size,
                        same and size == len(source),
                    ))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in columns)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"],
                )
            release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run, keep=True), DIGEST)
