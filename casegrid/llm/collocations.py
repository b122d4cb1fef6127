r"""Collocations by dynamic itemset counting over phrases.

The corpus is dealt into shards that are scanned in a cycle, over and over. All words are counted from
the first shard on. A longer phrase becomes active with the shard after the one where both its
subphrases (without its last and without its first word) have reached the threshold, whatever length
is being counted then, and stays active for exactly one cycle: then it has met every shard once, and its
count is exact. Scanning ends when no phrase is active and none can become so.

What is active is known to a scan through fixed-size bit tables over phrase hashes, which let a few
others pass; a join with the exact steps removes these before anything is added up. A first pass over
the corpus, which also writes the shards, counts words and pairs of words in hash buckets, as many as
an eighth of the corpus has bytes: what falls into a bucket below the threshold cannot reach it and is
never written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casegrid.llm.bytetext import LOWER, RollingHash, Texts, chunks, mix
from casegrid.session import scratch_path

LONGEST = 4
THRESHOLD = 30
SHARDS = 4
BEST = 2_000
# Hash buckets of the first pass, in blocks that travel one by one. Each is a byte in a task and a bit in
# what is broadcast, hence the bound: beyond it more of what stays below the threshold is written.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 27
BLOCK = 1 << 16
# Most phrases (16 bytes each) that are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST = 1 << 20
# Bits of the tables of phrases that have reached the threshold.
BITS = 1 << 24
# Occurrences that a task holds before it adds them up and writes them.
HELD = 4 << 20
# Parts in which the phrases of one language are ranked before the best of all parts are.
PARTS = 64

# What ends a piece of text, and what stands between words.
_STOP, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK[[0x20, 0x09]] = True

_LOOK = {"kind": "int", "shard": "int", "lang": "string", "text": "string", "block": "int", "counts": "binary", "n": "bigint"}
# A phrase is told by the hashes of its prefix and suffix, its own follows from them: it is not shuffled.
_SEEN = {"size": "int", "lang": "string", "prefix": "bigint", "suffix": "bigint", "word": "string", "n": "bigint"}
_STATE = {**_SEEN, "start": "int", "reached": "int", "done": "boolean"}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in schema.items())


def _batch(schema: dict[str, str], **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(rows, _ARROW[t]) if c not in columns
            else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], _ARROW[t])
            for c, t in schema.items()
        ],
        list(schema),
    )


class Words:
    """The words of a chunk of texts: hashes that differ by language, pieces, languages, and places in ``data``."""

    def __init__(self, part: pa.RecordBatch):
        texts = Texts(part.column("text"))
        self.data = LOWER[texts.data]
        stop = _STOP[self.data]
        inside = ~(_BLANK[self.data] | stop)
        edge = np.zeros(len(self.data) + 1, bool)
        edge[texts.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        owner = np.searchsorted(texts.offsets, self.starts, "right") - 1
        self.pieces = np.cumsum(stop)[self.starts] + owner
        langs = part.column("lang").fill_null("und").dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        seeds = [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in self.names]
        self.langs = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
        self.hashes = np.zeros(0, np.uint64)
        if len(self.starts):
            self.hashes = mix(RollingHash(self.data).spans(self.starts, self.ends) ^ np.array(seeds, np.uint64)[self.langs])


def _joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their parts without the last and without the first word: as ``HASH`` in SQL."""
    x = prefix ^ ((suffix << np.uint64(1)) | (suffix >> np.uint64(63)))
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x << np.uint64(31)) | (x >> np.uint64(33))
    x *= np.uint64(0x9E3779B185EBCA87)
    x ^= np.uint64((42 + 0x27D4EB2F165667C5 + 8) & 0xFFFFFFFFFFFFFFFF)
    x = (x << np.uint64(27)) | (x >> np.uint64(37))
    x = x * np.uint64(0x9E3779B185EBCA87) + np.uint64(0x85EBCA77C2B2AE63)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


# Spark's xxhash64 of one bigint; a word is its own prefix and suffix.
HASH = "if(size = 1, prefix, xxhash64(prefix ^ (shiftleft(suffix, 1) | shiftrightunsigned(suffix, 63))))"


def _bucket(hashes: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Buckets of words and of pairs differ."""
    return ((hashes >> np.uint64(20 + size)) & np.uint64(buckets - 1)).astype(np.int64)


def _buckets_for(docs: DataFrame) -> int:
    """A power of two of about an eighth of the bytes of all texts."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (int(size) // 8).bit_length()))


def _deal(docs: DataFrame, shards: int, n_buckets: int, path: str) -> DataFrame:
    """Write all texts by shard (kind 0), each task's buckets (kind 1) and words by language (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, number, total = None, TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = part.num_rows
                shard = (np.arange(number, number + rows) % shards).astype(np.int32)
                number += rows
                yield _batch(_LOOK, kind=np.zeros(rows, np.int32), shard=shard, lang=part.column("lang"), text=part.column("text"))
                words = Words(part)
                for i, k in enumerate(np.bincount(words.langs, minlength=len(words.names)).tolist()):
                    total[words.names[i]] = total.get(words.names[i], 0) + k
                buckets = np.zeros(n_buckets, np.uint8) if buckets is None else buckets
                begins = np.flatnonzero(words.pieces[:-1] == words.pieces[1:])
                pairs = _joined(words.hashes[begins], words.hashes[begins + 1])
                place, times = np.unique(np.concatenate([_bucket(words.hashes, 1, n_buckets), _bucket(pairs, 2, n_buckets)]), return_counts=True)
                buckets[place] = np.minimum(buckets[place] + times, 255)
        if buckets is not None:
            place = np.flatnonzero(buckets)
            block = place // BLOCK
            for b in np.unique(block):
                some = place[np.searchsorted(block, b) : np.searchsorted(block, b, "right")]
                gaps = np.diff(some % BLOCK, prepend=0).astype("<u2")
                packed = zlib.compress(gaps.tobytes() + buckets[some].tobytes(), 1)
                yield _batch(_LOOK, kind=[1], shard=[0], block=[int(b)], counts=[packed])
        if total:
            yield _batch(_LOOK, lang=list(total), n=list(total.values()), kind=[2] * len(total), shard=[0] * len(total))

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, _ddl(_LOOK)).write.partitionBy("kind", "shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_ddl(_LOOK)).parquet(path)


def _possible(dealt: DataFrame, threshold: int, n_buckets: int) -> np.ndarray:
    """Which buckets reach the threshold: a bit each, so of bounded size whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(BLOCK, np.int64)

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(total >= threshold).tobytes()])], ["block", "bits"])

        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if block != current:
                    if current is not None:
                        yield bits()
                    current, total = block, np.zeros(BLOCK, np.int64)
                raw = zlib.decompress(packed)
                n = len(raw) // 3
                place = np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64))
                times = np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int64)
                # A full counter may stand for more.
                total[place] += np.where(times == 255, threshold, times)
        if current is not None:
            yield bits()

    # Ordered by block, so that a task holds one block at a time, however many tasks have written it.
    blocks = dealt.where("kind = 1").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros(n_buckets // 8, np.uint8)
    for row in blocks.mapInArrow(add, "block int, bits binary").toArrow().to_pylist():
        out[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _tables(reached: DataFrame, step: int, shards: int) -> np.ndarray:
    """Two bit tables, packed: phrases that have reached the threshold, and those that did within the last cycle."""
    place = F.col("hash").bitwiseAND(BITS - 1)
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))")
    rows = reached.groupBy(F.shiftright(place, 6).cast("int").alias("place")).agg(
        F.bit_or(bit).alias("any"), F.bit_or(F.when(F.col("reached") > step - 1 - shards, bit).otherwise(F.lit(0).cast("bigint"))).alias("late")
    ).toArrow()
    out = np.zeros((2, BITS // 64), np.int64)
    at = rows.column("place").to_numpy()
    out[0, at], out[1, at] = rows.column("any").to_numpy(), rows.column("late").to_numpy()
    return out


def _scan(shard: DataFrame, step: int, shards: int, longest: int, n_buckets: int, possible, tables) -> DataFrame:
    """Occurrences of what may be active in a shard, added up inside tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = possible.value

        def allowed(hashes: np.ndarray, size: int) -> np.ndarray:
            bucket = _bucket(hashes, size, n_buckets)
            return (bits[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1

        flags = np.zeros(BITS, np.uint8)
        for i, packed in enumerate(tables.value):
            flags |= np.unpackbits(packed.view(np.uint8), bitorder="little") << np.uint8(i)
        langs: dict[str, int] = {}
        held: dict[int, list[tuple]] = {}
        count = 0

        def flush():
            names = pa.array(list(langs), pa.string())
            for size, parts in held.items():
                hashes, lang, prefix, suffix, times = (np.concatenate(c) for c in zip(*(p[:5] for p in parts)))
                keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                total = np.bincount(inverse, weights=times).astype(np.int64)
                spelt = {}
                if size == 1:
                    words = [w for p in parts for w in p[5]]
                    spelt["word"] = pa.array([words[i] for i in first.tolist()], pa.string())
                yield _batch(_SEEN, size=np.full(len(keys), size, np.int32), lang=names.take(pa.array(lang[first])),
                             prefix=prefix[first].view(np.int64), suffix=suffix[first].view(np.int64), n=total, **spelt)

        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part)
                known = np.array([langs.setdefault(name, len(langs)) for name in words.names], np.int64)
                flag = flags[(words.hashes & np.uint64(BITS - 1)).astype(np.int64)]
                if step < shards and len(words.hashes):
                    some = np.flatnonzero(allowed(words.hashes, 1))
                    keys, first, times = np.unique(words.hashes[some], return_index=True, return_counts=True)
                    at = some[first]
                    raw = words.data.tobytes()
                    spelt = [raw[a:b].decode() for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
                    held.setdefault(1, []).append((keys, known[words.langs[at]], keys, keys, times, spelt))
                    count += len(keys)
                # Shorter phrases and the words at which they begin, level by level.
                shorter, begins = words.hashes, np.arange(len(words.hashes))
                for size in range(2, longest + 1):
                    if len(shorter) < 2:
                        break
                    # Where the shorter phrases at a word and the next begin.
                    left = np.flatnonzero((begins[1:] == begins[:-1] + 1) & (words.pieces[begins[:-1]] == words.pieces[begins[1:]]))
                    right = left + 1
                    hashes, at = _joined(shorter[left], shorter[right]), begins[left]
                    a, b = flag[left], flag[right]
                    use = (a & b & 1) & ((a | b) >> 1) == 1
                    some = np.flatnonzero(use)
                    if size == 2:
                        some = some[allowed(hashes[some], 2)]
                    held.setdefault(size, []).append((
                        hashes[some], known[words.langs[at[some]]], shorter[left[some]], shorter[right[some]], np.ones(len(some), np.int64)
                    ))
                    count += len(some)
                    shorter, begins = hashes, at
                    flag = flags[(hashes & np.uint64(BITS - 1)).astype(np.int64)]
                if count >= HELD:
                    yield from flush()
                    held, count = {}, 0
        if count:
            yield from flush()

    return shard.select("lang", "text").mapInArrow(run, _ddl(_SEEN))


def count_phrases(docs: DataFrame, path: str, longest: int = LONGEST, threshold: int = THRESHOLD, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of up to ``longest`` words that occur ``threshold`` times or more in a language.

    Returns the phrases (``size, lang, hash, prefix, suffix, word, n``; hashes are of 64 bits, and those
    of the phrase without its last or first word lead to its words) and ``lang, total`` with all words
    of each language. Everything is written below ``path``.
    """
    spark: SparkSession = docs.sparkSession
    n_buckets = _buckets_for(docs)
    dealt = _deal(docs, shards, n_buckets, f"{path}/dealt")
    possible = spark.sparkContext.broadcast(_possible(dealt, threshold, n_buckets))

    def state(before: int) -> tuple[DataFrame, DataFrame]:
        """Phrases that have completed their cycle before a step, and those within it."""
        if not before:
            empty = spark.createDataFrame([], _ddl(_STATE))
            return empty, empty
        rows = spark.read.schema(f"{_ddl(_STATE)}, step int").parquet(f"{path}/state")
        return rows.where("done").drop("step"), rows.where((F.col("step") == before - 1) & ~F.col("done")).drop("step")

    step = 0
    while True:
        finished, active = state(step)
        known = finished.unionByName(active).where((F.col("size") < longest) & F.col("reached").isNotNull()).select(F.expr(HASH).alias("hash"), "reached")
        # Anything to scan for: phrases in their cycle, or some that may start longer ones.
        if step and active.isEmpty() and known.where(F.col("reached") > step - 1 - shards).isEmpty():
            break
        tables = spark.sparkContext.broadcast(_tables(known, step, shards))
        shard = dealt.where((F.col("kind") == 0) & (F.col("shard") == step % shards))
        seen = _scan(shard, step, shards, longest, n_buckets, possible, tables)
        # The step at which each is to start, exactly; few enough to be broadcast, or not.
        small = known.count() <= MAX_BROADCAST
        starts = [known.select(F.col("hash").alias(c), F.col("reached").alias(f"{c}_reached")) for c in ("prefix", "suffix")]
        for side, c in zip(starts, ("prefix", "suffix")):
            seen = seen.join(F.broadcast(side) if small else side, c, "left")
        both = F.col("prefix_reached").isNotNull() & F.col("suffix_reached").isNotNull()
        start = F.when(F.col("size") == 1, 0).when(both, 1 + F.greatest("prefix_reached", "suffix_reached"))
        counted = seen.withColumn("start", start).where(F.col("start") > step - shards).select(*_SEEN, "start")
        counted = counted.withColumn("reached", F.lit(None).cast("int")).unionByName(active.select(*_SEEN, "start", "reached"))
        total = counted.groupBy(*[c for c in _SEEN if c != "n"], "start").agg(F.sum("n").alias("n"), F.min("reached").alias("reached"))
        total = (
            total.withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= threshold, step)))
            .withColumn("done", F.col("start") + shards - 1 <= step)
            .where("not done or reached is not null").withColumn("step", F.lit(step))
        )
        total.select(*_STATE, "step").write.mode("append").partitionBy("step", "done").parquet(f"{path}/state")
        tables.destroy()
        step += 1
    possible.destroy()
    langs = dealt.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("total"))
    return finished.select(*_SEEN, F.expr(HASH).alias("hash")), langs


def _spelt(phrases: DataFrame, path: str, longest: int) -> list[DataFrame]:
    """Phrases of 1, 2, .. words with their text, the counts of their parts at every cut, and the phrases inside.

    The first words of a phrase are those of its prefix, the last those of its suffix.
    """
    spark = phrases.sparkSession
    none = F.array().cast("array<bigint>")
    level = phrases.where("size = 1").select(
        "hash", "lang", "n", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"), none.alias("inside")
    )
    out = []
    for size in range(1, longest + 1):
        if size > 1:
            shorter = out[-1].drop("lang")
            left, right = (shorter.select(*[F.col(c).alias(f"{side}_{c}") for c in shorter.columns]) for side in "pq")
            inside = F.array() if size == 2 else F.array("p_hash", "q_hash")
            level = (
                phrases.where(F.col("size") == size).join(left, F.col("prefix") == F.col("p_hash")).join(right, F.col("suffix") == F.col("q_hash"))
                .select(
                    "hash", "lang", "n", F.concat_ws(" ", "p_phrase", "q_last").alias("phrase"), F.col("q_last").alias("last"),
                    F.concat("p_heads", F.array("p_n")).alias("heads"), F.concat(F.array("q_n"), "q_tails").alias("tails"),
                    F.array_distinct(F.concat(inside.cast("array<bigint>"), "p_inside", "q_inside")).alias("inside"),
                )
            )
        level.write.parquet(f"{path}/spelt-{size}")
        out.append(spark.read.parquet(f"{path}/spelt-{size}"))
    return out


def collocations(
    docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, best: int = BEST, shards: int = SHARDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language of ``docs(lang, text)``.

    Texts, A-Z in lower case, are cut into pieces at ``.,;:!?`` and line ends, and those into words at
    spaces and tabs; no phrase reaches over the end of a piece. A null text has no words, a null
    language is ``und``, whole texts of any length are read, repeated rows count as often as they
    come, and of other columns none is looked at. ``a`` are the occurrences of the phrase, overlapping
    ones included, ``l`` and ``r`` those of its two parts at the cut with the lowest score (of equal
    scores the first cut), ``n`` the words of the language, and the score is the integer part of
    2,000,000 a / (l + r). A phrase inside a longer one that occurs 0.8 times as often or more is left
    out. Ranks go by score and ``a``, both falling, then by the bytes of the phrase.
    """
    path = scratch_path(docs.sparkSession, "collocations")
    phrases, langs = count_phrases(docs, path, longest, threshold, shards)
    levels = _spelt(phrases, path, longest)
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)
    longer = found.select(F.explode("inside").alias("hash"), F.col("n").alias("m")).groupBy("hash").agg(F.max("m").alias("longer"))
    found = found.join(longer, "hash", "left").where("longer is null or 100 * longer < 80 * n")
    # Decimals: products may pass 64 bits.
    cut = (
        "struct(cast(2000000 as decimal(18,0)) * cast(n as decimal(20,0))"
        " div (cast(heads[k - 1] as decimal(20,0)) + cast(tails[k - 1] as decimal(20,0))) as score,"
        " k, heads[k - 1] as l, tails[k - 1] as r)"
    )
    scored = found.withColumn("cut", F.expr(f"array_min(transform(sequence(1, size(heads)), k -> {cut}))")).select(
        "lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score"
    )
    # The best of each part first, so that no task ranks all phrases of a language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    for keys in (["lang", "part"], ["lang"]):
        scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        scored = scored.where(F.col("rank") <= best).drop("part")
    return scored.join(langs, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


# Phrases of every length are counted in full; the rest is as in collocations.
ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM p, range(1, 5) AS ks(k) WHERE len(words) >= k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(n) AS total FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, phrase, n, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 30
), parts AS MATERIALIZED (
  SELECT lang, phrase, n, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), cuts AS (
  SELECT p.lang, p.phrase, p.n, j, x.n AS l, y.n AS r, CAST(2000000 AS HUGEINT) * p.n // (x.n + y.n) AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.head JOIN f y ON y.lang = p.lang AND y.phrase = p.tail
), s AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, phrase AS longer, n
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS ms(m) WHERE m < k)
), dropped AS (
  SELECT DISTINCT s.lang, s.phrase FROM s JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE 100 * i.n >= 80 * s.n
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, n DESC, encode(phrase)) AS rank
  FROM s ANTI JOIN dropped USING (lang, phrase)
)
SELECT lang, rank, phrase, CAST(n AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(total AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
