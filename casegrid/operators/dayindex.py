"""An index over the Gold fact: 64 days to a row, as a bitmap of active days and running sums of cases.

A row stands for one condition, cell, age group and gender in 64 consecutive days, a word. Its cases
between two days are the difference of two of its running sums, and its days a mask over its bitmap.
Days of several demographics are one bitmap by ``bit_or`` and are counted by ``bit_count``, so no
query needs a step per day or a distinct count. A window of 90 days reads three words per group at
most, whatever the history behind them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from casegrid.functions.dates import clamp_window, date_key
from casegrid.operators.hotspots import Filters, selection
from casegrid.operators.joins import join_groups

WORD_BITS = 6  # of a day number, for its place in a word
GROUP = ["condition_code", "h3", "age_group", "gender"]
_EPOCH = dt.date(1970, 1, 1)


def day_number(date: Column) -> Column:
    """Days since 1970; NULL for text that is no date."""
    return F.date_diff(F.to_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))), F.lit(_EPOCH))


def _number(date: str) -> int:
    return (dt.date.fromisoformat(date) - _EPOCH).days


def _date(number: Column) -> Column:
    return date_key(F.date_add(F.lit(_EPOCH), number))


def build_day_index(fact: DataFrame) -> DataFrame:
    """``condition_code, h3, age_group, gender, word, bits, running``; rows without a readable day stay out.

    ``running`` has an entry per set bit, in order: the cases up to that day within the word.
    """
    day = day_number(F.col("date_key"))
    daily = fact.select(*GROUP, day.alias("day"), "case_count").where("day is not null")
    daily = daily.groupBy(*GROUP, "day").agg(F.sum("case_count").alias("n"))
    bit = F.col("day").bitwiseAND(63)
    words = daily.groupBy(*GROUP, F.shiftright("day", WORD_BITS).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, day & 63)")).alias("bits"),
        F.sort_array(F.collect_list(F.struct(bit.alias("bit"), "n"))).alias("days"),  # 64 at most
    )
    running = F.expr("transform(sequence(1, size(days)), i -> aggregate(slice(days, 1, i), 0L, (sum, d) -> sum + d.n))")
    return words.withColumn("running", running).drop("days")


def latest_days(index: DataFrame) -> DataFrame:
    """``condition_code, latest``: the last active day of each condition, as a number."""
    last = F.max(F.struct("word", (F.length(F.bin("bits")) - 1).alias("bit")))
    words = index.groupBy("condition_code", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("condition_code").agg((last["word"] * 64 + last["bit"]).alias("latest"))


def within(index: DataFrame, first: Column, last: Column) -> DataFrame:
    """Groups that are active between two days: ``word, bits`` of these days and their ``cases``."""
    start, end = first - F.col("word") * 64, last - F.col("word") * 64
    lowest, highest = F.greatest(start, F.lit(0)), F.least(end, F.lit(63))
    rows = index.where((F.col("word") >= F.shiftright(first, WORD_BITS)) & (F.col("word") <= F.shiftright(last, WORD_BITS)))
    rows = rows.withColumns({"_low": lowest.cast("int"), "_high": highest.cast("int")})
    upto = "shiftrightunsigned(-1L, 63 - _high)"
    rows = rows.withColumns({
        "_inside": F.expr(f"bits & shiftleft(-1L, _low) & {upto}"),
        "_before": F.expr("bit_count(bits & ~shiftleft(-1L, _low))"),
        "_upto": F.expr(f"bit_count(bits & {upto})"),
    }).where("_inside <> 0")
    cases = F.expr("running[_upto - 1] - if(_before = 0, 0L, running[greatest(_before, 1) - 1])")
    return rows.select(*[c for c in index.columns if c not in ("bits", "running")], F.col("_inside").alias("bits"), cases.alias("cases"))


def _bounds(filters: Filters) -> tuple[Column, Column]:
    """The asked days as numbers; open ends reach over all days a date can have."""
    first = _number(filters.start_date or "0001-01-01")
    return F.lit(first), F.lit(_number(filters.end_date or "9999-12-31"))


def _chosen(index: DataFrame, filters: Filters) -> DataFrame:
    """The demographics and condition of a query; its days are a matter of words and bits."""
    return index.where(selection(index, Filters(filters.condition_code, None, None, filters.age_groups, filters.genders)))


def hotspots_of(active: DataFrame) -> DataFrame:
    """Per cell: cases, latest day and number of days, from what :func:`within` gives."""
    words = active.groupBy("condition_code", "h3", "word").agg(F.sum("cases").alias("cases"), F.bit_or("bits").alias("bits"))
    last = F.col("word") * 64 + F.length(F.bin("bits")) - 1
    return (
        words.groupBy("condition_code", "h3")
        .agg(F.sum("cases").alias("case_count"), F.max(last).alias("last"), F.sum(F.bit_count("bits")).alias("days_with_cases"))
        .where("case_count > 0")
        .select("condition_code", "h3", "case_count", _date(F.col("last")).alias("latest_date"), F.col("days_with_cases").cast("bigint"))
    )


def hotspots(index: DataFrame, filters: Filters) -> DataFrame:
    """:func:`casegrid.operators.hotspots.hotspots`, answered from the index."""
    return hotspots_of(within(_chosen(index, filters), *_bounds(filters)))


def hotspot_stats(index: DataFrame, filters: Filters) -> DataFrame:
    """Always one row: total cases and active days of the selection, answered from the index."""
    active = within(_chosen(index, filters), *_bounds(filters))
    words = active.groupBy("word").agg(F.sum("cases").alias("n"), F.bit_or("bits").alias("bits"))
    return words.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("total_cases"),
        F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("bigint").alias("active_days"),
    )


def daily_cells(index: DataFrame, filters: Filters) -> DataFrame:
    """Cases per day and cell: the differences of neighbouring running sums of each active day."""
    first, last = _bounds(filters)
    rows = _chosen(index, filters).where(
        (F.col("word") >= F.shiftright(first, WORD_BITS)) & (F.col("word") <= F.shiftright(last, WORD_BITS))
    )
    places = F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")
    days = F.expr(
        "transform(places, (bit, i) -> struct(word * 64 + bit as day, running[i] - if(i = 0, 0L, running[greatest(i, 1) - 1]) as n))"
    )
    each = rows.withColumn("places", places).select("condition_code", "h3", F.inline(days)).where(F.col("day").between(first, last))
    daily = each.groupBy("condition_code", "day", "h3").agg(F.sum("n").alias("case_count"))
    return daily.select("condition_code", _date(F.col("day")).alias("date_key"), "h3", "case_count")


def daily_series(index: DataFrame, filters: Filters) -> DataFrame:
    """Positive daily counts per cell in date order, answered from the index."""
    return daily_cells(index, filters).where("case_count > 0").orderBy("date_key", "condition_code", "h3")


def window_hotspots(index: DataFrame, anchors: DataFrame, days, filters: Filters = Filters()) -> DataFrame:
    """Hotspots of the ``days`` days that end at the latest day of each condition.

    ``anchors`` are :func:`latest_days`, a row per condition, kept beside the index.
    """
    anchored = join_groups(_chosen(index, filters), anchors, ["condition_code"])
    first = F.col("latest") - (clamp_window(days) - 1)
    return hotspots_of(within(anchored, first, F.col("latest")))
