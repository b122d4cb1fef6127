r"""Line deduplication through deletion neighbourhoods, with DataFrame functions only.

A line is a piece between ``\n``, trimmed of white space; lines under ``min_chars`` characters are
never dropped. A line goes if it equals an earlier one, or if an earlier line is within one edit (a
character inserted, deleted or replaced). Order is by (doc_id, text, line number), null ids last.

Every line has the strings left by deleting one of its characters. Two lines of equal length are one
replacement apart exactly if they share such a string with the same place of deletion; a line is one
insertion from another exactly if it is one of the other's strings. So equal keys are grouped, not
paired: the earliest of a group is all that its members need.

Long strings have many such rests, so the place of an edit is first narrowed down with the same idea
in coarse steps: of ``PARTS`` parts of a string an edit leaves all but one as they are. The string
without one part, hashed, has to meet that of another line, and the part it lacks is what is looked
at next, until it has no more than ``FINE`` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegrid.llm.common import written
from casegrid.session import scratch_path

MIN_CHARS = 20
PARTS = 3
FINE = 64
# Most keys (8 bytes each) that are broadcast to pick lines; beyond, the join is a shuffle.
MAX_BROADCAST_KEYS = 1 << 20


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, row, no, line, h`` of the lines that can be dropped; ``row`` tells rows of one doc_id apart."""
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
        .withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
        .withColumn("h", F.xxhash64("line"))
    )


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "no")


def _parts(text: Column, role: Column, before: Column) -> Column:
    """For each part of a string: the hash of the rest, and the part.

    ``role`` is 1 where the string is to be the longer one of two; parts are cut by the length of the
    shorter, and the part of the longer has one more character.
    """
    n = F.length(text)
    m = n - role
    out = []
    for part in range(PARTS):
        begin, end = F.floor(m * part / PARTS).cast("int"), F.floor(m * (part + 1) / PARTS).cast("int")
        key = F.xxhash64(before, m, F.lit(part), F.substr(text, F.lit(1), begin), F.substr(text, end + role + 1, n))
        out.append(F.struct(key.alias("key"), role.alias("role"), F.substr(text, begin + 1, end - begin + role).alias("middle")))
    return F.array(*out)


def _picked(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, broadcast only where they are few."""
    return df.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys, on, "left_semi")


def _meeting(rows: DataFrame, path: str) -> DataFrame:
    """Rows ``h, key, ...`` whose key is also that of another line."""
    keys = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    return _picked(rows, written(keys, path), "key")


def _near(lines: DataFrame, path: str) -> DataFrame:
    """``h`` of the lines (each with its first place) that have an earlier line within one edit."""
    zero, one = F.lit(0), F.lit(1)
    line = F.col("line")
    rows = lines.select("*", F.inline(F.concat(_parts(line, zero, zero), _parts(line, one, zero))))
    met = _meeting(rows, f"{path}/keys-0").groupBy("h", "key", "role").agg(
        F.min(_place()).alias("place"), F.any_value("middle").alias("middle"), F.any_value("line").alias("line")
    )
    rows, level = written(met, f"{path}/rows-0"), 0
    candidates = rows.groupBy("h").agg(F.min("place").alias("place"), F.any_value("line").alias("line"))
    candidates = written(candidates, f"{path}/candidates")
    rows = rows.select("h", "key", "role", "middle")
    m = F.length("middle") - F.col("role")
    while (rows.agg(F.max(m)).first()[0] or 0) > FINE:
        level += 1
        cut = rows.where(m > FINE).select("h", F.inline(_parts(F.col("middle"), F.col("role"), F.col("key"))))
        rows = written(_meeting(cut, f"{path}/keys-{level}").unionByName(rows.where(m <= FINE)).distinct(), f"{path}/rows-{level}")
    # The rests of what is left: with one character deleted, and of the shorter role whole.
    n = F.length("middle")
    rest = lambda i: F.xxhash64("key", F.concat(F.substr("middle", one, i - 1), F.substr("middle", i + 1, n)))
    deleted = F.when(n > 0, F.transform(F.sequence(one, F.greatest(n, one)), lambda i: F.struct(i.alias("at"), rest(i).alias("rest"))))
    itself = F.when(F.col("role") == 0, F.array(F.struct(zero.alias("at"), F.xxhash64("key", "middle").alias("rest"))))
    none = F.array().cast("array<struct<at:int,rest:bigint>>")
    variants = rows.select("h", "role", F.inline(F.concat(F.coalesce(itself, none), F.coalesce(deleted, none))))
    met = _meeting(variants.withColumnRenamed("rest", "key"), f"{path}/rests").distinct().join(candidates.select("h", "place"), "h")
    met = written(met, f"{path}/variants")
    first = F.min(F.struct("place", "h")).alias("first")
    # A replacement: two of the shorter role with the same rest at the same place.
    replaced = met.where("role = 0 and at > 0")
    replaced = replaced.join(replaced.groupBy("key", "at").agg(first), ["key", "at"]).select("h", "place", "first")
    # An insertion: a whole string and a rest of a longer one.
    whole, longer = met.where("role = 0 and at = 0"), met.where("role = 1")
    inserted = whole.join(longer.groupBy("key").agg(first), "key").select("h", "place", "first").unionByName(
        longer.join(whole.groupBy("key").agg(first), "key").select("h", "place", "first")
    )
    earlier = replaced.unionByName(inserted).where("first.place < place").groupBy("h").agg(F.min("first").alias("first"))
    a, b = candidates.select("h", "line"), candidates.select(F.col("h").alias("first_h"), F.col("line").alias("first_line"))
    return (
        earlier.select("h", F.col("first.h").alias("first_h")).join(a, "h").join(b, "first_h")
        .where(F.levenshtein("line", "first_line", 1).between(0, 1)).select("h")
    )


def deduplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, counts: bool = False) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; no row is lost, its text may become empty.

    ``counts`` adds ``n_lines`` and ``n_dropped``. Null texts stay null. Rows with one doc_id and text are
    treated alike; other columns pass through. Lines are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "lines")
    lines = _lines(docs, min_chars)
    near = written(_near(lines, path), f"{path}/near").select("h", F.lit(True).alias("near"))
    repeated = (
        lines.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("k")).where("k > 1")
        .join(near, "h", "full_outer").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    repeated = written(repeated, f"{path}/repeated")
    few = repeated.count() <= MAX_BROADCAST_KEYS // 4  # wider rows
    places = lines.select("doc_id", "row", "no", "h")
    drops = (
        places.join(F.broadcast(repeated) if few else repeated, "h")
        .where(F.col("near") | (F.col("first") != _place()))
        .groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("no")).alias("drops"))
        .select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "drops")
    )
    drops = written(drops, f"{path}/drops")
    found = docs.alias("d").join(
        drops.alias("x"),
        F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("x._id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("x._row")), "left",
    )
    pieces = F.split(F.col("d.text").cast("string"), "\n", -1)
    kept = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(F.col("x.drops"), i)), "\n")
    text = F.when(F.col("x.drops").isNull(), F.col("d.text").cast("string")).otherwise(kept).alias("text")
    columns = [text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    if counts:
        columns += [
            F.when(F.col("d.text").isNull(), 0).otherwise(F.size(pieces)).cast("bigint").alias("n_lines"),
            F.coalesce(F.size("x.drops"), F.lit(0)).cast("bigint").alias("n_dropped"),
        ]
    return found.select(*columns)


# The same without the coarse step: every line emits its strings.
ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, text, i - 1 AS no, trim(ls[i], ' ') AS line
  FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
  WHERE length(trim(ls[i], ' ')) >= {MIN_CHARS}
), u AS (
  SELECT line, min(ROW(doc_id, no)) AS place FROM l GROUP BY line
), v AS (
  SELECT line, place, i AS pos, CASE WHEN i = 0 THEN line ELSE substr(line, 1, i - 1) || substr(line, i + 1) END AS rest
  FROM (SELECT line, place, unnest(range(0, length(line) + 1)) AS i FROM u)
), h AS (SELECT line, place, pos, md5_number(rest) AS rest FROM v
), near AS (
  SELECT line FROM (SELECT line, place, min(place) OVER (PARTITION BY rest, pos) AS f FROM h WHERE pos > 0) WHERE f < place
  UNION
  SELECT a.line FROM h a JOIN h b ON a.rest = b.rest AND (a.pos = 0) <> (b.pos = 0) WHERE b.place < a.place
), x AS (
  SELECT l.doc_id, l.text, l.no FROM l JOIN u USING (line) WHERE u.place <> ROW(l.doc_id, l.no) OR l.line IN (SELECT line FROM near)
), g AS (SELECT doc_id, text, list(no) AS nos FROM x GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.nos), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN g.nos IS NULL THEN d.text
    ELSE array_to_string(list_filter(d.ls, lambda s, i: NOT list_contains(g.nos, i - 1)), chr(10)) END) AS text_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.text = g.text
"""
