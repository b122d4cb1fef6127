"""Exact allocation, ranks over groups of any size, time remapping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from casegrid.functions.dates import iso_utc
from casegrid.functions.text import surrogate_cell_id
from casegrid.operators import allocate, ranking
from casegrid.operators.remap import remap_time, with_time_range
from casegrid.queries import data
from casegrid.queries.data import table
from casegrid.queries.registry import query


def _orders(spark, sf):
    """Orders as units: grouped by priority, weighted by customer number, 5 000 cases per priority."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_custkey") % 50).cast("double").alias("weight"),
        F.lit(5000).cast("bigint").alias("total"),
    )


def _largest_remainder(units: str, group: str, order: str, unit_columns: str) -> str:
    return f"""
    u AS ({units}),
    s AS (SELECT *, sum(weight) OVER (PARTITION BY {group}) AS w, count(*) OVER (PARTITION BY {group}) AS n FROM u),
    r AS (SELECT *, CASE WHEN w > 0 THEN weight / w ELSE 1e0 / n END * greatest(total, 0) AS exact FROM s),
    e AS (SELECT *, round(exact, 9) AS raw FROM r),
    f AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base, raw - floor(raw) AS fraction FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY fraction DESC, {order}) AS rank,
                 greatest(total, 0) - sum(base) OVER (PARTITION BY {group}) AS remainder FROM f),
    allocated AS (SELECT {unit_columns}, base + CASE WHEN rank <= remainder THEN 1 ELSE 0 END AS allocated FROM k)"""


_ORDER_UNITS = """SELECT o_orderkey, o_orderpriority, CAST(o_custkey % 50 AS DOUBLE) AS weight, 5000 AS total FROM orders"""


@query("proportional_allocation", sql=f"""
    WITH {_largest_remainder(_ORDER_UNITS, 'o_orderpriority', 'o_orderkey', 'o_orderkey, o_orderpriority')}
    SELECT * FROM allocated""")
def proportional_allocation(spark, sf):
    given = allocate.allocate(_orders(spark, sf), ["o_orderpriority"], "weight", "total", ["o_orderkey"])
    return given.select("o_orderkey", "o_orderpriority", "allocated")


@query("proportional_allocation_small_groups", sql=f"""
    WITH {_largest_remainder('SELECT event_id, user_id, value AS weight, user_id % 5 * 100 AS total FROM events',
                             'user_id', 'event_id', 'event_id, user_id, total')}
    SELECT user_id, CAST(count(*) AS BIGINT) AS units, CAST(sum(allocated) AS BIGINT) AS allocated FROM allocated GROUP BY user_id""")
def proportional_allocation_small_groups(spark, sf):
    units = table(spark, sf, "events").select(
        "event_id", "user_id", F.col("value").alias("weight"), (F.col("user_id") % 5 * 100).alias("total")
    )
    given = allocate.allocate(units, ["user_id"], "weight", "total", ["event_id"])
    return given.groupBy("user_id").agg(F.count("*").alias("units"), F.sum("allocated").alias("allocated"))


@query("subgroup_allocation", "cities", sql=f"""
    WITH {_largest_remainder("SELECT city, iso2 = 'US' AS us, CAST(greatest(population, 1) AS DOUBLE) AS weight,"
                             " CASE WHEN iso2 = 'US' THEN 700 ELSE 300 END AS total FROM cities", 'us', 'city', 'city, us')}
    SELECT city, us, allocated FROM allocated""")
def subgroup_allocation(spark, sf):
    units = data.cities(spark, sf).select(
        "city", (F.col("iso2") == "US").alias("us"),
        F.greatest(F.col("population").cast("bigint"), F.lit(1)).cast("double").alias("weight"),
    )
    return allocate.allocate_with_subgroup(units, "weight", 1000, F.col("us"), 700, ["city"]).drop("weight")


_AGES = {"0-17": 1.0, "18-34": 4.0, "35-54": 2.0, "55+": 1.0}
_GENDERS = {"male": 1.0, "female": 1.0}


@query("hierarchical_allocation", sql=f"""
    WITH day_units AS (
        SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS date_key, sum(l_quantity) AS weight, o_custkey AS total
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey > 0 GROUP BY ALL),
    {_largest_remainder('SELECT * FROM day_units', 'l_orderkey', 'date_key', 'l_orderkey, date_key')
     .replace(' AS allocated FROM k', ' AS day_total FROM k').replace('allocated AS', 'per_day AS')},
    grid AS (SELECT * FROM (VALUES (0, '0-17', 'male', 0.0625e0), (1, '0-17', 'female', 0.0625e0), (2, '18-34', 'male', 0.25e0),
        (3, '18-34', 'female', 0.25e0), (4, '35-54', 'male', 0.125e0), (5, '35-54', 'female', 0.125e0),
        (6, '55+', 'male', 0.0625e0), (7, '55+', 'female', 0.0625e0)) g(demo_idx, age_group, gender, share)),
    raws AS (SELECT l_orderkey, date_key, day_total, demo_idx, age_group, gender, round(share * day_total, 9) AS raw
             FROM per_day, grid WHERE day_total > 0),
    floors AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM raws),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, date_key ORDER BY raw - base DESC, demo_idx) AS rank,
                      day_total - sum(base) OVER (PARTITION BY l_orderkey, date_key) AS remainder FROM floors)
    SELECT l_orderkey, date_key, age_group, gender, CAST(base + CASE WHEN rank <= remainder THEN 1 ELSE 0 END AS BIGINT) AS case_count
    FROM ranked WHERE base + CASE WHEN rank <= remainder THEN 1 ELSE 0 END > 0""")
def hierarchical_allocation(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("total"))
    days = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date_key"))
        .agg(F.sum("l_quantity").alias("day_weight"))
    )
    return allocate.hierarchical_allocation(units, "l_orderkey", "total", days, _AGES, _GENDERS)


@query("weight_share", sql="""
    SELECT o_orderkey, o_orderpriority, (o_custkey % 50) / sum(o_custkey % 50) OVER (PARTITION BY o_orderpriority) AS share FROM orders""")
def weight_share(spark, sf):
    shared = allocate.weight_share(_orders(spark, sf), ["o_orderpriority"], "weight")
    return shared.select("o_orderkey", "o_orderpriority", "share")


@query("position_ratio", sql="""
    SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)
           / CAST(greatest(count(*) OVER () - 1, 1) AS DOUBLE) AS ratio FROM orders""")
def position_ratio(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranking.position_ratio(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).drop("o_totalprice")


@query("surrogate_ids", sql="""
    SELECT c_name, '842a' || lpad(lower(to_hex(row_number() OVER (ORDER BY c_acctbal DESC, c_name) - 1)), 6, '0') || 'ffffffff' AS h3
    FROM customer""")
def surrogate_ids(spark, sf):
    rows = table(spark, sf, "customer").select("c_name", "c_acctbal")
    numbered = ranking.distributed_row_number(rows, [F.col("c_acctbal").desc(), F.col("c_name")])
    return numbered.select("c_name", surrogate_cell_id(F.col("row_number") - 1).alias("h3"))


@query("top_cities", "cities", sql="""
    SELECT city, country, iso2, lat, lng, population FROM cities
    WHERE population >= 50000 AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180
    ORDER BY population DESC, city LIMIT 10000""")
def top_cities(spark, sf):
    return ranking.top_cities(data.cities(spark, sf), max_cities=10_000, min_population=50_000)


@query("time_remap", sql="""
    WITH b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events WHERE event_id % 3 <> 0),
    t AS (SELECT epoch_us(TIMESTAMP '2026-01-01 00:00:00') AS dlo, epoch_us(TIMESTAMP '2026-12-31 23:59:59') AS dhi)
    SELECT event_id, strftime(make_timestamp(CASE WHEN event_id % 7 = 0 THEN dhi ELSE
             dlo + CAST(round(least(1, greatest(0, (epoch_us(ts) - lo) / CAST(hi - lo AS DOUBLE))) * (dhi - dlo)) AS BIGINT) END),
             '%Y-%m-%dT%H:%M:%SZ') AS moved
    FROM events, b, t""")
def time_remap(spark, sf):
    events = table(spark, sf, "events")
    events = with_time_range(events, events.where("event_id % 3 <> 0"), "ts")
    stamp = F.when(F.col("event_id") % 7 != 0, F.col("ts"))
    target = (dt.datetime(2026, 1, 1), dt.datetime(2026, 12, 31, 23, 59, 59))
    return events.select("event_id", iso_utc(remap_time(stamp, F.col("_range"), target)).alias("moved"))


@query("demographic_grid", sql="""
    SELECT c_custkey, a.age_group, g.gender, a.w * g.w / 16 AS weight
    FROM customer, (VALUES ('0-17', 1e0), ('18-34', 4e0), ('35-54', 2e0), ('55+', 1e0)) a(age_group, w),
         (VALUES ('male', 1e0), ('female', 1e0)) g(gender, w)""")
def demographic_grid(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey")
    return allocate.demographic_grid(people, _AGES, _GENDERS).drop("demo_idx")
