"""Window queries, cumulative frames and hotspot merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.functions.geo import cell_center
from casegrid.operators import dayindex, frames, gold, hotspots, merge
from casegrid.operators.hotspots import Filters
from casegrid.queries import data
from casegrid.queries.data import centre_sql, haversine_sql
from casegrid.queries.registry import query
from casegrid.session import scratch_path
from casegrid.sources import gold as gold_store

_LAT, _LON = centre_sql("h3")
_CHOSEN = Filters(age_groups=("18-34", "35-54", "55+"), genders=("male", "female", "unknown"))
_CHOSEN_SQL = "age_group IN ('18-34', '35-54', '55+') AND gender IN ('male', 'female', 'unknown')"
_WINDOW_SQL = """SELECT f.* FROM fact f JOIN (SELECT condition_code, max(date_key) AS latest FROM fact GROUP BY 1) a USING (condition_code)
    WHERE f.date_key >= strftime(CAST(a.latest AS DATE) - INTERVAL 89 DAY, '%Y-%m-%d') AND f.date_key <= a.latest"""


def _day_index(fact):
    """The index of a fact, written and read again."""
    path = gold_store.write_day_index(dayindex.build_day_index(fact), dayindex.latest_days, scratch_path(fact.sparkSession, "index"))
    return gold_store.read_day_index(fact.sparkSession, path)


_HOTSPOTS_WINDOW = f"""
    WITH w AS ({_WINDOW_SQL})
    SELECT condition_code, condition_code AS condition_display, h3, {_LAT} AS lat, {_LON} AS lon,
           CAST(sum(case_count) AS BIGINT) AS cases, CAST(sum(case_count) AS BIGINT) AS original_cases,
           max(date_key) AS latest_date, count(DISTINCT date_key) AS days_with_cases
    FROM w WHERE {_CHOSEN_SQL} GROUP BY condition_code, h3 HAVING sum(case_count) > 0"""


@query("hotspots_window_indexed", "fact", "conditions", sql=_HOTSPOTS_WINDOW)
def hotspots_window_indexed(spark, sf):
    """The same from the day index: the fact is not looked at again."""
    fact = data.published_fact(spark, sf)
    index, latest = _day_index(fact)
    summary = data.written(gold.condition_cells(fact), "condition-cells")
    cells, conditions = gold.cells_dim(summary, data.STAMP), gold.conditions_dim(summary, data.STAMP)
    points = dayindex.window_hotspots(index, latest, 90, _CHOSEN)
    return hotspots.labelled_points(points, cells, conditions)


@query("hotspots_window", "fact", "conditions", sql=_HOTSPOTS_WINDOW)
def hotspots_window(spark, sf):
    """The filtered 90-day hotspot query for every condition, each anchored on its latest day."""
    fact = data.published_fact(spark, sf)
    summary = data.written(gold.condition_cells(fact), "condition-cells")
    cells, conditions = gold.cells_dim(summary, data.STAMP), gold.conditions_dim(summary, data.STAMP)
    return hotspots.hotspot_points(fact, cells, conditions, 90, data.AS_OF, _CHOSEN)


@query("hotspots_one_condition", "fact", sql=f"""
    WITH f AS (SELECT * FROM fact WHERE condition_code = '3-MEDIUM')
    SELECT condition_code, h3, CAST(sum(case_count) AS BIGINT) AS case_count, max(date_key) AS latest_date,
           count(DISTINCT date_key) AS days_with_cases
    FROM f WHERE date_key >= (SELECT strftime(CAST(max(date_key) AS DATE) - INTERVAL 179 DAY, '%Y-%m-%d') FROM f) AND {_CHOSEN_SQL}
    GROUP BY condition_code, h3""")
def hotspots_one_condition(spark, sf):
    """One condition of a published fact: only its partition is read, from the window's first day on."""
    rows = hotspots.window_rows(data.published_fact(spark, sf), 500, "3-MEDIUM", data.AS_OF)
    return hotspots.hotspots(rows, _CHOSEN)


@query("filter_predicate", "dense_fact", sql=f"""
    SELECT condition_code, h3, CAST(sum(case_count) AS BIGINT) AS case_count, max(date_key) AS latest_date,
           count(DISTINCT date_key) AS days_with_cases
    FROM dense_fact WHERE date_key >= '1997-01-01' AND date_key <= '1999-12-01' AND condition_code = '4-NOT SPECIFIED' AND {_CHOSEN_SQL}
    GROUP BY condition_code, h3 HAVING sum(case_count) > 0""")
def filter_predicate(spark, sf):
    chosen = Filters("4-NOT SPECIFIED", "1997-01-01", "1999-12-01", _CHOSEN.age_groups, _CHOSEN.genders)
    return hotspots.hotspots(data.dense_fact(spark, sf), chosen)


_STATS = f"""
    SELECT CAST(coalesce(sum(case_count), 0) AS BIGINT) AS total_cases, count(DISTINCT date_key) AS active_days
    FROM fact WHERE date_key BETWEEN '1996-01-01' AND '1999-12-31' AND {_CHOSEN_SQL}"""


@query("hotspot_stats_indexed", "fact", sql=_STATS)
def hotspot_stats_indexed(spark, sf):
    chosen = Filters(None, "1996-01-01", "1999-12-31", _CHOSEN.age_groups, _CHOSEN.genders)
    return dayindex.hotspot_stats(_day_index(data.fact(spark, sf))[0], chosen)


@query("filter_predicate_indexed", "dense_fact", sql=f"""
    SELECT condition_code, h3, CAST(sum(case_count) AS BIGINT) AS case_count, max(date_key) AS latest_date,
           count(DISTINCT date_key) AS days_with_cases
    FROM dense_fact WHERE date_key >= '1997-01-01' AND date_key <= '1999-12-01' AND condition_code = '4-NOT SPECIFIED' AND {_CHOSEN_SQL}
    GROUP BY condition_code, h3 HAVING sum(case_count) > 0""")
def filter_predicate_indexed(spark, sf):
    """One condition's partition of the index, and the words of the asked days."""
    chosen = Filters("4-NOT SPECIFIED", "1997-01-01", "1999-12-01", _CHOSEN.age_groups, _CHOSEN.genders)
    return dayindex.hotspots(_day_index(data.dense_fact(spark, sf))[0], chosen)


@query("daily_series_indexed", "dense_fact", sql=f"""
    SELECT condition_code, date_key, h3, CAST(sum(case_count) AS BIGINT) AS case_count
    FROM dense_fact WHERE date_key >= '1996-02-01' AND {_CHOSEN_SQL} GROUP BY ALL HAVING sum(case_count) > 0""")
def daily_series_indexed(spark, sf):
    chosen = Filters(None, "1996-02-01", None, _CHOSEN.age_groups, _CHOSEN.genders)
    return dayindex.daily_series(_day_index(data.dense_fact(spark, sf))[0], chosen)


@query("hotspot_stats", "fact", sql=_STATS)
def hotspot_stats(spark, sf):
    chosen = Filters(None, "1996-01-01", "1999-12-31", _CHOSEN.age_groups, _CHOSEN.genders)
    return hotspots.hotspot_stats(data.fact(spark, sf), chosen)


@query("hotspot_stats_empty_selection", "fact", sql="""
    SELECT CAST(coalesce(sum(case_count), 0) AS BIGINT) AS total_cases, count(DISTINCT date_key) AS active_days
    FROM fact WHERE 1 = 0""")
def hotspot_stats_empty_selection(spark, sf):
    return hotspots.hotspot_stats(data.fact(spark, sf), Filters(age_groups=()))


_DAILY = """
    SELECT condition_code, date_key, h3, CAST(sum(case_count) AS BIGINT) AS case_count
    FROM event_days GROUP BY ALL HAVING sum(case_count) > 0"""


@query("daily_series", "event_days", sql=_DAILY)
def daily_series(spark, sf):
    return hotspots.daily_series(data.event_day_cells(spark, sf), Filters())


@query("series_order", "event_days", sql=f"""
    WITH d AS ({_DAILY})
    SELECT row_number() OVER (PARTITION BY condition_code ORDER BY date_key, h3) AS position, condition_code, date_key, h3 FROM d""")
def series_order(spark, sf):
    from casegrid.operators.ranking import distributed_row_number

    series = hotspots.daily_series(data.event_day_cells(spark, sf), Filters()).drop("case_count")
    return distributed_row_number(series, [F.col("date_key"), F.col("h3")], ["condition_code"], "position")


@query("latest_date", "fact", sql="""
    SELECT condition_code, max(date_key) AS latest_date, '2001-08-02' AS without_data FROM fact GROUP BY condition_code""")
def latest_date(spark, sf):
    fact = data.fact(spark, sf)
    nothing = hotspots.latest_date(fact, "no such code", data.AS_OF)
    return hotspots.latest_dates(fact).withColumn("without_data", nothing.scalar())


@query("cell_lookup", "fact", sql=f"""
    SELECT condition_code, coalesce(CASE WHEN condition_code <> '5-LOW' THEN 'label ' || condition_code END, condition_code) AS condition_display,
           h3, CASE WHEN c.known THEN 10e0 ELSE {_LAT} END AS lat, CASE WHEN c.known THEN 20e0 ELSE {_LON} END AS lon
    FROM (SELECT DISTINCT condition_code, h3 FROM fact) f
    LEFT JOIN (SELECT DISTINCT h3, true AS known FROM fact WHERE date_key < '1995-03-01') c USING (h3)""")
def cell_lookup(spark, sf):
    fact = data.fact(spark, sf)
    spots = fact.select("condition_code", "h3").distinct()
    known = fact.where("date_key < '1995-03-01'").select("h3").distinct().select(
        "h3", F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude")
    )
    labels = fact.where("condition_code <> '5-LOW'").select("condition_code").distinct().withColumn(
        "condition_display", F.concat(F.lit("label "), "condition_code")
    )
    return hotspots.with_labels(hotspots.with_geography(spots, known), labels)


_FRAME_START, _FRAME_END = "2023-12-28", "2024-01-31"
_FRAMES = f"""
    d AS (SELECT condition_code, date_key, h3, CAST(sum(case_count) AS BIGINT) AS n FROM event_days GROUP BY ALL HAVING sum(case_count) > 0),
    axis AS (SELECT strftime(x, '%Y-%m-%d') AS frame_date FROM unnest(generate_series(TIMESTAMP '{_FRAME_START}', TIMESTAMP '{_FRAME_END}', INTERVAL 1 DAY)) t(x)),
    frames AS (SELECT d.condition_code, a.frame_date, d.h3, CAST(sum(d.n) AS BIGINT) AS cases, CAST(sum(d.n) AS BIGINT) AS original_cases,
                      count(*) AS days_with_cases, max(d.date_key) AS latest_date
               FROM axis a JOIN d ON d.date_key <= a.frame_date AND d.date_key >= '{_FRAME_START}' GROUP BY ALL)"""


@query("cumulative_frames", "event_days", sql=f"WITH {_FRAMES} SELECT * FROM frames")
def cumulative_frames(spark, sf):
    return frames.cumulative_frames(data.event_day_cells(spark, sf), _FRAME_START, _FRAME_END)


@query("frame_stats", "event_days", sql=f"""WITH {_FRAMES}
    SELECT c.condition_code, a.frame_date, CAST(coalesce(sum(f.cases), 0) AS BIGINT) AS total_cases, count(f.h3) AS cell_count,
           CAST((SELECT count(DISTINCT date_key) FROM d WHERE d.condition_code = c.condition_code AND d.date_key <= a.frame_date) AS BIGINT) AS active_days
    FROM (SELECT DISTINCT condition_code FROM event_days) c CROSS JOIN axis a
    LEFT JOIN frames f ON f.condition_code = c.condition_code AND f.frame_date = a.frame_date
    GROUP BY c.condition_code, a.frame_date""")
def frame_stats(spark, sf):
    return frames.frame_stats(data.event_day_cells(spark, sf), _FRAME_START, _FRAME_END)


# --- distance-based operators ---------------------------------------------------------------------

_ZOOM, _WORLD_ZOOM = 6, 2


def _radius_sql(zoom: int, cases: str) -> str:
    low = f"900 + 4100 / (1 + exp(0.9e0 * ({zoom} - 6)))"
    return f"greatest({low}, (120000 + least(1, {cases} / 50000e0) * 180000) * exp(-0.62e0 * ({zoom} - 2))) * 1.3e0 / 1000"


def _pairs_sql(zoom: int, base_km: int) -> str:
    limit = f"greatest({base_km}, 2 * {_radius_sql(zoom, '50000')})"
    km = haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")
    gap = "abs(a.lon - b.lon)"
    return f"""pairs AS (
    SELECT a.condition_code, a.h3 AS a_h3, b.h3 AS b_h3, {km} AS km
    FROM p a JOIN p b ON a.condition_code = b.condition_code AND (a.lat < b.lat OR (a.lat = b.lat AND a.h3 < b.h3))
    WHERE b.lat - a.lat <= {limit} / 110.574e0
      AND CASE WHEN {gap} > 180 THEN 360 - {gap} ELSE {gap} END
          <= least(180, {limit} / greatest(8, 111.32e0 * cos(radians(a.lat))))
      AND {km} <= greatest({base_km}, {_radius_sql(zoom, 'a.cases')} + {_radius_sql(zoom, 'b.cases')}))"""


def _scaled_points(spark, sf):
    """Points whose cases are scaled up, so that radii differ from cell to cell."""
    return data.points(spark, sf).withColumn("cases", F.col("cases") * 1000).withColumn("original_cases", F.col("cases"))


_SCALED = "p AS (SELECT * REPLACE (cases * 1000 AS cases) FROM points)"


@query("coordinate_dedupe", "dense_fact", sql=f"""
    SELECT condition_code, min(h3) AS h3, {_LAT.replace('h3', 'min(h3)')} AS lat, {_LON.replace('h3', 'min(h3)')} AS lon,
           CAST(sum(case_count) AS BIGINT) AS cases, max(case_count) AS original_cases, count(*) AS merged_count,
           CAST(1 AS BIGINT) AS days_with_cases, max(date_key) AS latest_date
    FROM dense_fact GROUP BY condition_code, h3""")
def coordinate_dedupe(spark, sf):
    """Every fact row as a point at its cell centre: points of one coordinate become one."""
    rows = data.dense_fact(spark, sf).select(
        "condition_code", "h3", F.col("case_count").alias("cases"), F.col("date_key").alias("latest_date")
    )
    lat, lon = cell_center(F.col("h3"))
    return merge.collapse_coordinates(rows.withColumns({"lat": lat, "lon": lon}))


@query("near_pairs", "points", sql=f"""
    WITH {_SCALED}, {_pairs_sql(_ZOOM, 50)}
    SELECT condition_code, a_h3 AS h3, count(*) AS neighbours, round(min(km), 6) AS nearest_km, round(max(km), 6) AS farthest_km
    FROM pairs GROUP BY ALL""")
def near_pairs(spark, sf):
    """Merge candidates of every point, summarised per point."""
    pairs = merge.near_pairs(_scaled_points(spark, sf), _ZOOM)
    return pairs.groupBy("condition_code", F.col("a_h3").alias("h3")).agg(
        F.count("*").alias("neighbours"),
        F.round(F.min("distance_km"), 6).alias("nearest_km"),
        F.round(F.max("distance_km"), 6).alias("farthest_km"),
    )


@query("near_pairs_world", "world", sql=f"""
    WITH p AS (SELECT * FROM world), {_pairs_sql(_WORLD_ZOOM, 900)}
    SELECT condition_code, a_h3 AS h3, count(*) AS neighbours, min(b_h3) AS first_neighbour, max(b_h3) AS last_neighbour,
           round(min(km), 6) AS nearest_km, round(max(km), 6) AS farthest_km
    FROM pairs GROUP BY ALL""")
def near_pairs_world(spark, sf):
    """The same across the antimeridian and at all latitudes."""
    pairs = merge.near_pairs(data.world_points(spark, sf), _WORLD_ZOOM)
    return pairs.groupBy("condition_code", F.col("a_h3").alias("h3")).agg(
        F.count("*").alias("neighbours"),
        F.min("b_h3").alias("first_neighbour"),
        F.max("b_h3").alias("last_neighbour"),
        F.round(F.min("distance_km"), 6).alias("nearest_km"),
        F.round(F.max("distance_km"), 6).alias("farthest_km"),
    )


_WEIGHT = "power(p.cases, 1.25e0)"


@query("hotspot_components", "world", sql=f"""
    WITH RECURSIVE p AS (SELECT * FROM world), {_pairs_sql(_WORLD_ZOOM, 900)},
    links AS (SELECT condition_code, a_h3 AS x, b_h3 AS y FROM pairs UNION ALL SELECT condition_code, b_h3, a_h3 FROM pairs),
    reach(condition_code, h3, other) AS (
        SELECT condition_code, h3, h3 FROM p
        UNION SELECT r.condition_code, r.h3, l.y FROM reach r JOIN links l ON l.condition_code = r.condition_code AND l.x = r.other),
    labelled AS (SELECT condition_code, h3, min(other) AS component FROM reach GROUP BY condition_code, h3),
    merged AS (
        SELECT l.condition_code, l.component AS h3, sum(p.lat * {_WEIGHT}) / sum({_WEIGHT}) AS lat,
               CASE WHEN max(p.lon) - min(p.lon) > 180
                    THEN sum(CASE WHEN p.lon < 0 THEN p.lon + 360 ELSE p.lon END * {_WEIGHT}) / sum({_WEIGHT})
                    ELSE sum(p.lon * {_WEIGHT}) / sum({_WEIGHT}) END AS lon,
               CAST(sum(p.cases) AS BIGINT) AS cases, max(p.cases) AS original_cases, max(p.days_with_cases) AS days_with_cases,
               max(p.latest_date) AS latest_date, count(*) AS merged_count
        FROM labelled l JOIN p USING (condition_code, h3) GROUP BY l.condition_code, l.component)
    SELECT * REPLACE (round(lat, 5) AS lat, round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 5) AS lon) FROM merged""")
def hotspot_components(spark, sf):
    merged = merge.merge_hotspots(data.world_points(spark, sf), _WORLD_ZOOM)
    return merged.withColumns({"lat": F.round("lat", 5), "lon": F.round("lon", 5)})
