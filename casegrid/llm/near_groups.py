"""Sets that meet in lists, compared without turning a long list into all its pairs.

Shared by the similarity joins of this subpackage. ``lists`` are entries ``key, sid, n``: a set ``sid``
of ``n`` members is in the list of ``key``; linked sets share a list. Sets of long lists meet on what
sets them apart from the consensus of their group, the members that more than half of its sets have:
two sets differ in as many members as their differences do. Linked is a Jaccard similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casegrid.llm.bytetext import Texts, chunks
from casegrid.llm.common import written
from casegrid.llm.memo import lean
from casegrid.operators.components import connected_components

# Sets of a list that is compared pair by pair; beyond, its sets meet on their differences.
SHORT = 8
# Where asked for, a list of large sets is also compared pair by pair: up to a set for so many members that
# its sets have on average, and up to so many sets. Large texts that share a passage are in few lists
# together, and their pairs are far fewer than the members that set them apart.
MEMBERS_PER_ENTRY, MOST_PAIRED = 32, 64


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def settled(links: DataFrame, path: str) -> DataFrame:
    if links.isEmpty():
        return links.sparkSession.createDataFrame([], "sid bigint, component bigint")
    found = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return written(found.select(F.col("node").alias("sid"), "component"), path)


def labelled(lists: DataFrame, labels: DataFrame, path: str, by_size: bool = False) -> DataFrame:
    """Entries of lists that hold several components, with their own, the commonest, and a set of that.

    ``short`` says which lists are to be compared pair by pair, with ``by_size`` also by the size of
    their sets. Counts are combined before they are shuffled, so a long list costs a row per component
    and task.
    """
    entries = lists.join(labels, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    counted = entries.groupBy("key", "component").agg(F.count("*").alias("k"), F.max("sid").alias("leader"), F.sum("n").alias("members"))
    top = counted.groupBy("key").agg(
        F.max(F.struct("k", "component", "leader")).alias("top"), F.count("*").alias("of"), F.sum("k").alias("length"), F.sum("members").alias("members")
    ).where("of > 1")
    short = F.col("length") <= SHORT
    if by_size:
        short = short | ((F.col("length") <= MOST_PAIRED) & (MEMBERS_PER_ENTRY * F.col("length") * F.col("length") <= F.col("members")))
    top = top.select("key", F.col("top.component").alias("commonest"), F.col("top.leader").alias("leader"), "length", short.alias("short"))
    return written(entries.join(top, "key"), path)


# Sizes of two sets that can be linked.
FITS = "4 * greatest(l.n, r.n) <= 5 * least(l.n, r.n)"


def _differences(grouped: DataFrame, consensus: DataFrame) -> DataFrame:
    """``group, sid, n, component, element, d`` for every element in which a set and the consensus of its group differ, ``d`` in number."""
    own = ["group", "sid", "n", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "members"):
                found = [
                    np.setxor1d(np.frombuffer(x, "<i8"), np.array([] if y is None else y, np.int64), assume_unique=True)
                    for x, y in zip(part.column("members").to_pylist(), part.column("consensus").to_pylist())
                ]
                d = np.array([len(x) for x in found], np.int64)
                # A set that is the consensus itself has one row without an element.
                place = np.repeat(np.arange(len(d)), np.maximum(d, 1))
                element = pa.array([e for x in found for e in (x.tolist() or [None])], pa.int64())
                take = pa.array(place)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in own), element, pa.array(d[place])], [*own, "element", "d"])

    rows = grouped.join(consensus, "group", "left").select("group", "sid", F.col("n").cast("bigint").alias("n"), "component", "members", "consensus")
    return rows.mapInArrow(lean(run), "`group` bigint, sid bigint, n bigint, component bigint, element bigint, d bigint")


def group_pairs(mixed: DataFrame, members: DataFrame, path: str) -> DataFrame:
    """Pairs that may be links among the sets that long lists connect.

    Sets of n and m members are linked if they differ in at most (n + m) / 9; with differences of d
    and e to anything else they differ in d + e - 2 * (what those share). With ``rest = 9 * d - n``, two
    sets whose rests add up to 0 or less are linked, and both are to the set with the least rest: the
    star. All others need ``18 * shared >= rest + rest``, so a shared element at least.
    """
    long = mixed.where(~F.col("short"))
    if long.isEmpty():
        return mixed.sparkSession.createDataFrame([], "a bigint, b bigint")
    found = connected_components(long.select(F.col("sid").alias("src"), F.col("leader").alias("dst")))
    sets = long.select("sid", "n", "component").distinct().join(found.select(F.col("node").alias("sid"), F.col("component").alias("group")), "sid")
    sets = written(sets, path + "-sets")
    grouped = members.join(sets, "sid")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "members"):
                held = Texts(part.column("members"))
                element = np.frombuffer(held.data.tobytes(), "<i8")
                take = pa.array(np.repeat(np.arange(len(held)), np.diff(held.offsets) // 8))
                yield pa.RecordBatch.from_arrays([part.column("group").take(take), pa.array(element)], ["group", "element"])

    sizes = sets.groupBy("group").agg(F.count("*").alias("of"))
    common = grouped.select("group", "members").mapInArrow(lean(elements), "`group` bigint, element bigint").groupBy("group", "element").count()
    # At most twice the mean size of the group's sets.
    consensus = common.join(sizes, "group").where("2 * count > of").groupBy("group").agg(F.collect_list("element").alias("consensus"))
    # A set's own values come with its rows: a join would make those again wherever they are read.
    apart = written(_differences(grouped, consensus), path + "-apart").withColumn("rest", F.expr("9 * d - n"))

    least = apart.groupBy("group").agg(F.min_by(F.struct("sid", "rest", "component"), F.struct("rest", "sid")).alias("least"))
    star = (
        apart.select("group", "sid", "rest", "component").distinct().join(least, "group")
        .where("component <> least.component and rest + least.rest <= 0").select(*pair("sid", "least.sid"))
    )
    times = apart.where("element is not null").groupBy("group", "element").agg(
        F.count("*").alias("times"), (F.min("component") != F.max("component")).alias("mixed")
    )
    place = F.row_number().over(Window.partitionBy("sid").orderBy("times", "element")) - 1
    meeting = apart.join(times, ["group", "element"]).withColumn("left", F.col("d") - place).where("mixed")
    meeting = written(meeting.select("group", "element", "sid", "n", "component", "rest", "left"), path + "-meeting")
    pairs = (
        meeting.alias("l").join(meeting.alias("r"), F.expr(
            "l.group = r.group and l.element = r.element and l.component <> r.component and l.sid < r.sid"
            f" and l.rest + r.rest > 0 and 18 * least(l.left, r.left) >= l.rest + r.rest and {FITS}"
        ))
        .select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b"))
    )
    return star.unionByName(pairs)
