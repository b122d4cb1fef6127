"""Jaccard self-join of shingle sets, size-aware: subsets for small sets, inverted lists for large ones.

Two sets of sizes n and m have a Jaccard similarity of 0.8 or more exactly if they share at least
c = ceil(4 (n + m) / 9) members. Small sets meet on their c-subsets; of large sets only so many
members as must contain a common one are put into inverted lists, rarest first. The size where one
way becomes cheaper than the other is computed from the table.

Equal sets are one set. Every set is first compared with one partner of its lists only; sets found
linked are one component, and what is left to compare are sets of different components: pair by pair
in short lists, by what sets them apart from the consensus of their group in long ones (``near_groups``).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casegrid.llm.bytetext import Texts, chunks, mix
from casegrid.llm.common import written
from casegrid.llm.memo import lean
from casegrid.llm.near_groups import group_pairs, labelled, settled
from casegrid.llm.shingles import Sets
from casegrid.session import in_few_files, scratch_path

# Most entries of the broadcast table of frequent shingles (16 bytes each).
MAX_FREQUENT = 1 << 20
# Most ids of sets that are broadcast to pick texts; beyond, the texts are joined by a shuffle.
MAX_BROADCAST_IDS = 1 << 20
# Most sets whose parities (32 bytes each) are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_PARITIES = 1 << 18
# Shingles counted at once inside a task.
COUNTED = 2 << 20
# Sizes considered for the boundary between small and large sets.
MAX_SMALL = 16
# 64-bit words of a set's parities: of each of so many times 64 classes of members, whether their
# number is odd. Sets differ in as many members at least as parities.
PARITY_WORDS = 4
BUCKETS = 256  # of the histogram that bounds an overlap from above


def required(n, m):
    """Members that sets of these sizes must share."""
    return (4 * (n + m) + 8) // 9


def subset_sizes(n: int, largest: int) -> list[int]:
    """Sizes of the subsets on which a set of size n meets sets of other sizes up to ``largest``."""
    partners = [m for m in range(max(1, (4 * n + 4) // 5), min(largest, 5 * n // 4) + 1)]
    # Equal sets are one set already, so only subsets smaller than one of the two matter.
    return sorted({c for m in partners if (c := required(n, m)) < max(n, m) and c <= min(n, m)})


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size of small sets: where the work is least, in rows written and list entries read."""
    def light(x: int) -> float:
        return sum(k * sum(math.comb(n, c) for c in subset_sizes(n, x)) for n, k in sizes.items() if n <= x)

    def heavy(x: int) -> float:
        return sum(k * (n - (4 * n + 4) // 5 + 1) * (1 + list_length) for n, k in sizes.items() if n > 4 * x / 5)

    return min(range(MAX_SMALL + 1), key=lambda x: light(x) + heavy(x))


def _stats(docs: DataFrame, path: str) -> DataFrame:
    """One pass: a row per document (size and name of its set), and rows for shingles that repeat in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, count = np.zeros(0, np.int64), [], 0

        def tally():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return _batch(_STATS, key=values[some], n=n[some], kind=np.ones(int(some.sum()), np.int32))

        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")))
                names = sets.names()
                yield _batch(_STATS, doc_id=part.column("doc_id"), sid=names, n=sets.sizes, kind=np.zeros(len(names), np.int32))
                first = np.unique(names, return_index=True)[1]
                new = first[~np.isin(names[first], seen)]
                take = np.zeros(len(names), bool)
                take[new] = True
                seen = np.concatenate([seen, names[new]])
                held.append(sets.values[take[sets.owner]])
                count += len(held[-1])
                if count >= COUNTED:
                    yield tally()
                    seen, held, count = np.zeros(0, np.int64), [], 0
        if held:
            yield tally()

    return written(in_few_files(_texts(docs)).mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in _STATS.items())), path)


_STATS = {"kind": "int", "doc_id": "bigint", "sid": "bigint", "n": "bigint", "key": "bigint"}
_POSTINGS = {"key": "bigint", "sid": "bigint", "n": "int", "pos": "int", "leads": "boolean", "light": "boolean"}
_PARITIES = [f"parity_{i}" for i in range(PARITY_WORDS)]
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(schema: dict[str, str], **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    arrays = [
        pa.nulls(rows, _KINDS[t]) if c not in columns
        else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]).cast(_KINDS[t])
        for c, t in schema.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, list(schema))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _frequent(stats: DataFrame) -> np.ndarray:
    """Shingles known to be frequent, by ascending count: at most ``MAX_FREQUENT``, the most frequent ones."""
    counts = stats.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
    by_count = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    total, least = 0, 100_000
    for row in by_count:  # the smallest count whose table still fits
        total += row["count"]
        if total > MAX_FREQUENT:
            break
        least = row["n"]
    chosen = counts.where(F.col("n") >= least).limit(MAX_FREQUENT).toArrow()
    keys, n = (chosen.column(c).to_numpy() for c in ("key", "n"))
    return keys[np.lexsort((keys, n))]


def _postings(docs: DataFrame, frequent: np.ndarray, x: int) -> DataFrame:
    """The rows on which sets meet, each set once per task."""
    by_key = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, frequent[by_key], by_key))
    top = np.int64(1) << 52

    def light_rows(values: np.ndarray, n: int) -> Iterator[int]:
        for c in subset_sizes(n, x):
            spread = mix(values.astype(np.uint64))
            for chosen in itertools.combinations(range(n), c):
                yield int((mix(np.add.reduce(spread[list(chosen)], dtype=np.uint64).reshape(1) ^ np.uint64(c)) >> np.uint64(1))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, ordered, ranks = shared.value
        known = np.zeros(1 << 22, bool)
        known[ordered & ((1 << 22) - 1)] = True
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")))
                names = sets.names()
                take = np.zeros(len(names), bool)
                for i, name in enumerate(names.tolist()):
                    if name not in seen and sets.sizes[i]:
                        take[i] = True
                        seen.add(name)
                # Large sets, and small ones that may meet a large one: rarest members first.
                large = take & (sets.sizes * 5 >= 4 * (x + 1))
                some = np.flatnonzero(large[sets.owner])
                value, owner = sets.values[some], sets.owner[some]
                order = value.copy()
                maybe = np.flatnonzero(known[value & ((1 << 22) - 1)])
                if len(maybe) and len(ordered):
                    at = np.minimum(np.searchsorted(ordered, value[maybe]), len(ordered) - 1)
                    hit = ordered[at] == value[maybe]
                    order[maybe[hit]] = top + ranks[at[hit]]
                sort = np.lexsort((order, owner))
                value, owner = value[sort], owner[sort]
                n = sets.sizes[owner]
                position = np.arange(len(owner)) - np.searchsorted(owner, owner)
                use = position < n - (4 * n + 4) // 5 + 1
                value, owner, n, position = value[use], owner[use], n[use], position[use]
                yield _batch(
                    _POSTINGS, key=value, sid=names[owner], n=n, pos=position, leads=position < n - (8 * n + 8) // 9 + 1,
                    light=np.zeros(len(n), bool),
                )
                keys, sids, sizes = [], [], []
                for i in np.flatnonzero(take & (sets.sizes <= x)):
                    found = list(light_rows(sets.values[sets.bounds[i] : sets.bounds[i + 1]], int(sets.sizes[i])))
                    keys += found
                    sids += [names[i]] * len(found)
                    sizes += [sets.sizes[i]] * len(found)
                if keys:
                    yield _batch(
                        _POSTINGS, key=np.array(keys, np.int64), sid=np.array(sids, np.int64), n=np.array(sizes),
                        pos=np.zeros(len(keys), np.int32), leads=np.ones(len(keys), bool), light=np.ones(len(keys), bool),
                    )

    return _texts(docs).mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in _POSTINGS.items()))


def _set_table(docs: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """``sid, n, members, histogram`` of the wanted documents' sets."""
    n = wanted.count()
    rows = _texts(docs).join(F.broadcast(wanted) if n <= MAX_BROADCAST_IDS else wanted, "doc_id", "left_semi")
    schema = {"sid": "bigint", "n": "bigint", "members": "binary", "histogram": "binary", **{c: "bigint" for c in _PARITIES}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Sets(Texts(part.column("text")))
                cell = sets.owner * BUCKETS + (mix(sets.values.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
                counts = np.bincount(cell, minlength=len(sets.sizes) * BUCKETS).astype("<u2")
                classes = 64 * PARITY_WORDS
                cell = sets.owner * classes + (mix(~sets.values.astype(np.uint64)) % np.uint64(classes)).astype(np.int64)
                odd = np.bincount(cell, minlength=len(sets.sizes) * classes).astype(np.uint8) & 1
                words = np.packbits(odd).view(np.int64).reshape(-1, PARITY_WORDS)
                ends = np.arange(len(sets.sizes) + 1)
                cells = [
                    pa.Array.from_buffers(pa.binary(), len(sets.sizes), [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(d)])
                    for o, d in ((8 * sets.bounds, sets.values.astype("<i8")), (2 * BUCKETS * ends, np.minimum(counts, 65535)))
                ]
                yield _batch(schema, sid=sets.names(), n=sets.sizes, members=cells[0], histogram=cells[1],
                             **{c: words[:, i] for i, c in enumerate(_PARITIES)})

    return written(in_few_files(rows).mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in schema.items())), path)


def _passing(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs whose sets share enough by ``column``: the members, or histograms, which bound it from above."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("a_n"), F.col(column).alias("a_set"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("b_n"), F.col(column).alias("b_set"))
    exact = column == "members"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "a_set"):
                keep = []
                for n, m, x, y in zip(*(part.column(c).to_pylist() for c in ("a_n", "b_n", "a_set", "b_set"))):
                    if exact:
                        both = np.concatenate([np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                    else:
                        common = int(np.minimum(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")).sum())
                    keep.append(9 * common >= 4 * (n + m) or not exact and max(n, m) >= 65535)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(lean(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """Write those ``pairs(a, b)`` that are links. Whole sets travel only for pairs that histograms let through."""
    near = written(_passing(pairs, sets, "histogram"), path + "-near")
    ends = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    return written(_passing(near, sets.join(ends, "sid", "left_semi"), "members"), path)


def _close(a: str, b: str) -> str:
    """Can two entries of one list be the first common member of two linked sets?"""
    n, m = f"{a}.n", f"{b}.n"
    return (
        f"4 * greatest({n}, {m}) <= 5 * least({n}, {m}) and ({n} >= {m} or {a}.leads) and ({m} >= {n} or {b}.leads)"
        f" and ({n} <> {m} or {a}.leads or {b}.leads)"
        f" and 9 * (1 + least({n} - {a}.pos, {m} - {b}.pos) - 1) >= 4 * ({n} + {m})"
    )


def _attached(rows: DataFrame, by_sid: DataFrame, most: int, how: str) -> DataFrame:
    """Rows with what is known of their sets; broadcast only where that is of at most ``most`` sets."""
    return rows.join(F.broadcast(by_sid) if by_sid.count() <= most else by_sid, "sid", how)


def _short_pairs(mixed: DataFrame, sets: DataFrame, x: int, path: str) -> DataFrame:
    """Pairs of different components in short lists, as far as parities let through."""
    short = mixed.where("short")
    entries = written(_attached(short, sets.select("sid", *_PARITIES), MAX_BROADCAST_PARITIES, "inner"), path)
    apart = " + ".join(f"bit_count(l.{c} ^ r.{c})" for c in _PARITIES)
    return (
        entries.alias("l")
        .join(entries.alias("r"), F.expr(
            "l.key = r.key and l.component <> r.component and l.sid < r.sid"
            f" and (l.light or greatest(l.n, r.n) > {x}) and {_close('l', 'r')}"
            f" and 9 * ({apart}) <= l.n + r.n"
        ))
        .select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b"))
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Sets are the distinct 5-word shingles of the whole text, A-Z in lower case; a shorter text is one
    shingle, and a text without words, or null, has the empty set and is linked with nothing.
    ``component_id`` is the smallest doc_id that links of similarity 0.8 or more reach, itself included.
    Rows with one doc_id and different texts are one node. A row with a null doc_id keeps a null
    ``component_id``; its text links no others. Shingles are compared by 52-bit hashes.
    """
    spark: SparkSession = docs.sparkSession
    root = scratch_path(spark, "jaccard")
    stats = _stats(docs, f"{root}/stats")
    documents = stats.where("kind = 0").select("doc_id", "n", "sid")
    named = documents.where("doc_id is not null and n > 0")
    sizes = {r["n"]: r["k"] for r in named.where(F.col("n") <= 2 * MAX_SMALL).groupBy("n").agg(F.approx_count_distinct("sid").alias("k")).collect()}
    repeats = stats.where("kind = 1").agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("s")).first()["s"]
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
    frequent = _frequent(stats)
    x = boundary(sizes, 1 + float(repeats) / max(1, total))

    # Entries of lists with two sets or more.
    rows = _postings(docs.where("doc_id is not null"), frequent, x)
    same_key = Window.partitionBy("key")
    counted = rows.withColumn("least_sid", F.min("sid").over(same_key)).withColumn("most_sid", F.max("sid").over(same_key))
    lists = written(counted.where("least_sid <> most_sid").select(*_POSTINGS, "least_sid").distinct(), f"{root}/lists")

    # The sets in them, from the text of each one's first document.
    wanted = named.join(lists.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    sets = _set_table(docs, wanted.select("doc_id").distinct(), f"{root}/sets")
    # A set is there again where a doc_id has several rows: seen by the names alone, as the sets are large.
    if not sets.groupBy("sid").count().where("count > 1").isEmpty():
        sets = written(sets.dropDuplicates(["sid"]), f"{root}/one-of-each")

    # Each set against the first set of one of its lists: near copies become one component early.
    star = (
        lists.where("sid <> least_sid").groupBy("sid").agg(F.min("least_sid").alias("a"))
        .select("a", F.col("sid").alias("b"))
    )
    star = written(star, f"{root}/star")
    # Sets of one doc_id are one node.
    least = named.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("m")).where("a <> m")
    same_doc = named.join(least, "doc_id").where("sid <> a").select("a", F.col("sid").alias("b"))
    linked = _verified(star, sets, f"{root}/star-links").unionByName(same_doc)
    labels = settled(linked, f"{root}/components-1")

    # What is left: sets of different components, pair by pair in short lists, by what sets them apart in long ones.
    mixed = labelled(lists.drop("least_sid"), labels, f"{root}/mixed", by_size=True)
    pairs = _short_pairs(mixed, sets, x, f"{root}/entries").unionByName(group_pairs(mixed, sets.select("sid", "members"), f"{root}/groups"))
    pairs = written(pairs.distinct().join(star, ["a", "b"], "left_anti"), f"{root}/rest")
    more = _verified(pairs, sets, f"{root}/rest-links")
    if not more.isEmpty():
        labels = settled(linked.unionByName(more), f"{root}/components-2")

    found = documents.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    first = found.where("doc_id is not null and n > 0").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    # Only components of more than one document need the join back.
    return (
        found.join(first, "component", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("first_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component, the rows with its smallest doc_id.

    Rows with a null id stay, and so do all rows of a doc_id that stays. Documents with an empty set are
    linked with nothing and stay.
    """
    gone = jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
