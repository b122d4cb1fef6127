"""Operators on small fixtures, with properties that hold for any input."""

import collections
import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from casegrid import schemas
from casegrid.functions import severity
from casegrid.operators import allocate, dedupe, frames, deltas, gold, hotspots, merge, quality, ranking
from casegrid.operators.components import connected_components
from casegrid.operators.hotspots import Filters

AS_OF = dt.date(2026, 2, 28)
FACT = "condition_code string, date_key string, h3 string, age_group string, gender string, case_count bigint, city string, state string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def fact_of(spark, *entries):
    return spark.createDataFrame([(*e, "c", "s") for e in entries], FACT)


# --- dedupe and merges ---

VERSION = "patient_id string, name string, source_updated_at timestamp, created_at timestamp, updated_at timestamp"


def version(key, name, day, created=1):
    return key, name, dt.datetime(2026, 1, day), dt.datetime(2026, 2, created), dt.datetime(2026, 3, 1)


def test_merge_prefers_source_time(spark):
    base = spark.createDataFrame([version("a", "new", 9), version("b", "base", 1)], VERSION)
    delta = spark.createDataFrame(
        [version("a", "late arrival", 5, created=2), version("c", "added", 1), version(None, "lost", 1), version("", "lost", 1)], VERSION
    )
    merged = dedupe.merge_snapshot(base, delta, "patient_id")
    assert rows(merged.select("patient_id", "name")) == [("a", "new"), ("b", "base"), ("c", "added")]
    _, rejects = dedupe.split_rejects(delta, "patient_id")
    assert rejects.count() == 2


def test_merge_with_one_side(spark):
    delta = spark.createDataFrame([version("a", "x", 1), version("a", "y", 2)], VERSION)
    assert rows(dedupe.merge_snapshot(None, delta, "patient_id").select("name")) == [("y",)]
    assert dedupe.merge_snapshot(None, None, "patient_id") is None


def test_equal_times_are_repeatable(spark):
    versions = [version("a", name, 1) for name in "pqrst"]
    picks = set()
    for seed in range(4):
        random.Random(seed).shuffle(versions)
        picks.add(dedupe.latest_per_key(spark.createDataFrame(versions, VERSION), "patient_id").first()["name"])
    assert len(picks) == 1


def test_upsert(spark):
    old = fact_of(spark, ("c", "d", "x", "a", "g", 1), ("c", "d", "y", "a", "g", 2))
    new = fact_of(spark, ("c", "d", "x", "a", "g", 9), ("c", "d", "z", "a", "g", 3))
    once = gold.upsert_fact(old, new)
    assert rows(once.select("h3", "case_count")) == [("x", 9), ("y", 2), ("z", 3)]
    assert rows(gold.upsert_fact(once, new)) == rows(once)


def test_conform_and_cap(spark):
    df = spark.createDataFrame([(1, "5")], "extra int, case_count string")
    out = dedupe.conform(df, schemas.GOLD_FACT)
    assert out.columns == schemas.GOLD_FACT.fieldNames() and out.first()["case_count"] == 5
    capped = dedupe.cap_per_group(spark.range(10).withColumn("g", F.col("id") % 2), "g", 2, [F.col("id")])
    assert rows(capped) == [(0, 0), (1, 1), (2, 0), (3, 1)]


# --- gold ---

PATIENT = "patient_id string, dob string, gender string, latitude double, longitude double, city string, state string"
CONDITION = "condition_id string, patient_id string, condition_code string, condition_text string, condition_date timestamp"


def people_and_conditions(spark):
    people = spark.createDataFrame(
        [
            ("1", "1980-01-01", "M", 10.0, 10.0, "B", "S"), ("2", "1985-06-01", "male", 10.1, 10.1, "A", "S"),
            ("3", None, None, None, 10.0, "A", "S"), ("4", "2015-01-01", "f", 40.0, 10.0, "A", "S"),
        ],
        PATIENT,
    )
    day = dt.datetime(2026, 1, 2, 3)
    conditions = spark.createDataFrame(
        [
            ("a", "1", "840539006", "COVID", day), ("b", "2", "840539006", "COVID-19", day), ("c", "2", "840539006", "COVID", day),
            ("d", "3", "840539006", "COVID", day), ("e", "4", "a/b", "x", day), ("f", "9", "a/b", "x", day),
            ("g", "1", None, "x", day), ("h", "1", "a_b", "y", None),
        ],
        CONDITION,
    )
    return people, conditions


def test_gold_fact(spark):
    people, conditions = people_and_conditions(spark)
    fact = gold.gold_fact(conditions, people, AS_OF)
    got = rows(fact.select("condition_code", "date_key", "age_group", "gender", "case_count", "city"))
    assert got == [("840539006", "2026-01-02", "35-54", "male", 3, "A"), ("a/b", "2026-01-02", "0-17", "female", 1, "A")]


def test_dimensions(spark):
    people, conditions = people_and_conditions(spark)
    fact = gold.gold_fact(conditions, people, AS_OF)
    old = spark.createDataFrame([("kept", "Kept", 5, "t", 1, "[]", "[]")], schemas.CONDITIONS_DIM)
    dim = gold.conditions_dim(fact, "now", gold.condition_labels(conditions), old)
    assert rows(dim.select("condition_code", "condition_display", "patient_count", "total_unique")) == [
        ("840539006", "COVID", 3, 3), ("a/b", "x", 1, 3), ("kept", "Kept", 5, 3),
    ]
    cell = fact.first()["h3"]
    known = spark.createDataFrame([(cell, 1.0, 2.0, "t", 1)], schemas.CELLS_DIM)
    cells = gold.cells_dim(fact, "now", known)
    assert cells.count() == 2 and cells.where(F.col("h3") == cell).first()["latitude"] == 1.0


def test_refresh_removes_the_old_band_and_emptied_groups(spark):
    people, conditions = people_and_conditions(spark)
    before = gold.gold_fact(conditions, people, AS_OF)
    older = people.withColumn("dob", F.when(F.col("patient_id") == "4", "1950-01-01").otherwise(F.col("dob")))
    fewer = conditions.where("condition_id <> 'c'")
    after = gold.located_patients(older, AS_OF)
    changes = deltas.signed_cases(
        deltas.signed_changes(deltas.condition_forms(conditions), deltas.condition_forms(fewer)),
        deltas.signed_changes(gold.located_patients(people, AS_OF), after), gold.dated_conditions(conditions), after,
    )
    places = deltas.recounted_places(deltas.lost_places(before, changes), fewer, older, AS_OF)
    assert rows(deltas.apply_changes(before, changes, places)) == rows(gold.gold_fact(fewer, older, AS_OF))


# --- window queries ---


def test_empty_selections(spark):
    fact = fact_of(spark, ("c", "2026-01-01", "x", "55+", "male", 4))
    for filters in (Filters(age_groups=()), Filters(genders=()), Filters(start_date="2026-02-01", end_date="2026-01-01")):
        assert hotspots.hotspots(fact, filters).count() == 0
        assert rows(hotspots.hotspot_stats(fact, filters)) == [(0, 0)]
        assert hotspots.daily_series(fact, filters).count() == 0


def test_aliases(spark):
    df = spark.createDataFrame([("2026-01-01", "x", 3)], "Date string, H3 string, CaseCount int")
    fact = hotspots.canonical_fact(df)
    assert fact.columns == ["date_key", "h3", "case_count"]
    assert rows(hotspots.hotspots(fact, Filters("any"))) == [("x", 3, "2026-01-01", 1)]
    with pytest.raises(ValueError, match="date_key or date"):
        hotspots.canonical_fact(df.drop("Date"))


def test_first_number(spark):
    df = spark.createDataFrame([("x", 7), ("0", 7), ("NaN", 7), (None, 7), ("3", 7)], "a string, b int")
    assert [r[0] for r in df.select(hotspots.first_number(df, ["missing", "a", "b"])).collect()] == [7, 0, 7, 7, 3]


def test_negative_and_zero_cells_drop(spark):
    fact = fact_of(spark, ("c", "2026-01-01", "x", "55+", "male", 2), ("c", "2026-01-02", "x", "55+", "male", -2),
                   ("c", "2026-01-02", "y", "55+", "male", 1))
    assert [r["h3"] for r in hotspots.hotspots(fact, Filters()).collect()] == ["y"]


# --- frames ---


def test_frames(spark):
    daily = spark.createDataFrame(
        [("c", "2026-01-02", "x", 1), ("c", "2026-01-04", "x", 2), ("c", "2026-01-04", "y", 5), ("c", "2025-12-01", "z", 9)],
        "condition_code string, date_key string, h3 string, case_count bigint",
    )
    got = rows(frames.cumulative_frames(daily, "2026-01-01", "2026-01-05").select("frame_date", "h3", "cases", "days_with_cases", "latest_date"))
    assert got == [
        ("2026-01-02", "x", 1, 1, "2026-01-02"), ("2026-01-03", "x", 1, 1, "2026-01-02"),
        ("2026-01-04", "x", 3, 2, "2026-01-04"), ("2026-01-04", "y", 5, 1, "2026-01-04"),
        ("2026-01-05", "x", 3, 2, "2026-01-04"), ("2026-01-05", "y", 5, 1, "2026-01-04"),
    ]
    stats = rows(frames.frame_stats(daily, "2026-01-01", "2026-01-05").select("frame_date", "total_cases", "cell_count", "active_days"))
    assert stats == [
        ("2026-01-01", 0, 0, 0), ("2026-01-02", 1, 1, 1), ("2026-01-03", 1, 1, 1), ("2026-01-04", 8, 2, 2), ("2026-01-05", 8, 2, 2),
    ]


def test_last_frame_equals_the_hotspot_totals(spark):
    rng = random.Random(5)
    entries = [("c", f"2026-01-{rng.randint(1, 28):02d}", f"h{rng.randint(0, 6)}", "55+", "male", rng.randint(0, 3)) for _ in range(200)]
    fact = fact_of(spark, *entries)
    last = frames.cumulative_frames(fact, "2026-01-01", "2026-01-28").where("frame_date = '2026-01-28'")
    positive = fact.groupBy("condition_code", "date_key", "h3").agg(F.sum("case_count").alias("case_count")).where("case_count > 0")
    totals = hotspots.hotspots(positive, Filters())
    assert rows(last.select("h3", "cases", "latest_date", "days_with_cases")) == rows(
        totals.select("h3", "case_count", "latest_date", "days_with_cases")
    )


# --- allocation and ranks ---


def plain_allocation(total, weights):
    if total <= 0:
        return [0] * len(weights)
    whole = sum(weights)
    raw = [(w / whole if whole > 0 else 1 / len(weights)) * total for w in weights]
    parts = [math.floor(x) for x in raw]
    best = sorted(range(len(raw)), key=lambda i: (-(raw[i] - parts[i]), i))
    for i in best[: total - sum(parts)]:
        parts[i] += 1
    return parts


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.integers(-2, 40))
def test_allocation_matches_the_definition(spark, weights, total):
    df = spark.createDataFrame([("g", i, float(w), total) for i, w in enumerate(weights)], "g string, i int, w double, t bigint")
    expected = plain_allocation(total, weights)
    small = allocate.allocate(df, ["g"], "w", "t", ["i"]).orderBy("i").collect()
    assert [r["allocated"] for r in small] == expected
    assert sum(expected) == max(total, 0)


def test_allocation_of_any_group_size(spark):
    weights = [i % 7 for i in range(300)]
    df = spark.createDataFrame(
        [("g", i, float(w), 1001) for i, w in enumerate(weights)] + [("h", 0, 0.0, 3), ("h", 1, 0.0, 3)],
        "g string, i int, w double, t bigint",
    )
    got = allocate.allocate(df, ["g"], "w", "t", ["i"]).orderBy("g", "i").collect()
    assert [r["allocated"] for r in got if r["g"] == "g"] == plain_allocation(1001, weights)
    assert [r["allocated"] for r in got if r["g"] == "h"] == [2, 1]


def plain_hierarchy(units, days, shares):
    """Cases per unit, day and grid entry; the rows of a repeated unit share its total, those of a day count their floors together."""
    split = collections.defaultdict(list)
    for unit, times in collections.Counter(units).items():
        own = sorted(d for d in days if d[0] == unit[0] for _ in range(times))
        for (_, day, _), part in zip(own, plain_allocation(unit[1], [d[2] for d in own]) if own else []):
            split[unit[0], day] += [part] * (part > 0)
    out = collections.Counter()
    for (unit, day), parts in split.items():
        entries = sorted(((math.floor(s * t) - s * t, i, t) for t in parts for i, s in enumerate(shares)))
        given = sum(math.floor(s * t) for t in parts for s in shares)
        for rank, (_, i, t) in enumerate(entries, 1):
            out[unit, day, i, math.floor(shares[i] * t) + (rank <= t - given)] += 1
    return +collections.Counter({k: n for k, n in out.items() if k[3] > 0})


@pytest.mark.parametrize("whole_group", [1 << 17, 3])
@pytest.mark.parametrize("twice", [False, True])
def test_hierarchical_allocation_matches_the_definition(spark, monkeypatch, whole_group, twice):
    monkeypatch.setattr(allocate, "WHOLE_GROUP", whole_group)
    units = [(u, (u * 7) % 23 - 1) for u in [*range(40), *(range(0, 40, 3) if twice else ())]]
    days = [(u, f"2026-01-{d + 1:02d}", float((u + d) % 4)) for u in range(40) for d in range(u % 6)]
    got = allocate.hierarchical_allocation(
        spark.createDataFrame(units, "u int, t bigint"), "u", "t",
        spark.createDataFrame(days, "u int, date_key string, day_weight double"), {"a": 1.0, "b": 2.0, "c": 1.0}, {"f": 1.0, "m": 1.0},
    ).collect()
    entries = [(a, g) for a in "abc" for g in "fm"]
    seen = collections.Counter((r["u"], r["date_key"], entries.index((r["age_group"], r["gender"])), r["case_count"]) for r in got)
    assert seen == plain_hierarchy(units, days, [0.125, 0.125, 0.25, 0.25, 0.125, 0.125])


def test_hierarchical_allocation_shuffles_no_grid(spark):
    units = spark.range(50).selectExpr("id as u", "id * 3 as t")
    days = spark.range(200).selectExpr("id % 50 as u", "concat('d', id div 50) as date_key", "1e0 as day_weight")
    got = allocate.hierarchical_allocation(units, "u", "t", days, {"a": 1.0, "b": 1.0}, {"m": 1.0})
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate inline") < text.index("Window")


def test_groups_above_the_bound_are_allocated_across_tasks(spark, monkeypatch):
    rows_ = [(g, i, None if i % 11 == 5 else float(i * 5 % 7), 50) for g, n in (("x", 40), (None, 30), ("y", 5), ("z", 1)) for i in range(n)]
    df = spark.createDataFrame(rows_, "g string, i int, w double, t bigint")
    whole = allocate.allocate(df, ["g"], "w", "t", ["i"]).collect()
    spread = []
    monkeypatch.setattr(allocate, "WHOLE_GROUP", 10)
    monkeypatch.setattr(allocate, "distributed_row_number", lambda df, *a: spread.append(df) or ranking.distributed_row_number(df, *a))
    assert sorted(allocate.allocate(df, ["g"], "w", "t", ["i"]).collect(), key=str) == sorted(whole, key=str)
    assert {r["g"] for r in spread[0].collect()} == {"x", None}


def test_subgroup_total_is_limited_by_the_whole(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("b", False, 1.0), ("c", None, 1.0)], "city string, us boolean, w double")
    got = rows(allocate.allocate_with_subgroup(df, "w", 10, F.col("us"), 25, ["city"]).select("city", "allocated"))
    assert got == [("a", 10), ("b", 0), ("c", 0)]


def test_row_numbers_of_a_dominant_group(spark):
    df = spark.range(2000, numPartitions=7).withColumn("g", F.when(F.col("id") < 1900, "hot").otherwise((F.col("id") % 3).cast("string")))
    got = ranking.distributed_row_number(df, [F.col("id").desc()], ["g"])
    hot = got.where("g = 'hot'").orderBy("id").collect()
    assert [r["row_number"] for r in hot] == list(range(1900, 0, -1))
    assert got.groupBy("g").agg((F.max("row_number") == F.count("*")).alias("ok")).where("not ok").count() == 0


def test_position_ratio(spark):
    got = ranking.position_ratio(spark.range(5), [F.col("id")]).orderBy("id").collect()
    assert [r["ratio"] for r in got] == [0, 0.25, 0.5, 0.75, 1.0]
    assert ranking.position_ratio(spark.range(1), [F.col("id")]).first()["ratio"] == 0


def test_cities(spark):
    df = spark.createDataFrame(
        [("a", "1.5", "2", "60000"), ("b", "x", "2", "90000"), ("c", "95", "2", "90000"), ("d", "", "", "70000.9"), ("e", "1", "2", "10")],
        "city string, lat string, lng string, population string",
    )
    assert [(r["city"], r["population"]) for r in ranking.top_cities(df, 10_000, 50_000).collect()] == [("d", 70000), ("a", 60000)]
    assert [r["city"] for r in ranking.top_cities(df, 1, 50_000).collect()] == ["d"]


# --- components and merging ---


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)],
    [(0, i) for i in range(1, 30)] + [(100, 101)],
    [(a, b) for a, b in zip(random.Random(3).sample(range(300), 150), random.Random(4).sample(range(300), 150))],
    [(5, 5)],
])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == plain_components(edges)


POINT = "condition_code string, h3 string, lat double, lon double, cases bigint, latest_date string, days_with_cases bigint"


def random_points(seed, n, spread=20.0, lon0=170.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lon = lon0 + rng.uniform(0, spread)
        out.append(("c", f"p{i:03d}", rng.uniform(-5, 5) * spread / 10, lon - 360 if lon > 180 else lon, rng.randint(1, 60000), f"2026-01-{rng.randint(1, 28):02d}", rng.randint(1, 9)))
    return out


def km(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def radius(cases, zoom):
    return float(severity.radius_m_at(float(cases), zoom)) / 1000


def plain_pairs(points, zoom):
    limit, base = severity.max_threshold_km(zoom), severity.base_threshold_km(zoom)
    found = set()
    for a in points:
        for b in points:
            if (a[2], a[1]) >= (b[2], b[1]):
                continue
            gap = abs(a[3] - b[3])
            gap = 360 - gap if gap > 180 else gap
            inside = b[2] - a[2] <= limit / 110.574 and gap <= min(180, limit / max(8, 111.32 * math.cos(math.radians(a[2]))))
            if inside and km(a, b) <= max(base, radius(a[4], zoom) + radius(b[4], zoom)):
                found.add((a[1], b[1]))
    return found


def test_bounds_of_tiles_agree_with_their_points(spark):
    """Tiles that bounds accept or refuse are those of which all points, or none, are near."""
    rng, zoom, rows = random.Random(8), 2, []
    for tile in range(40):
        lat, lon, size = rng.uniform(-89, 89), rng.choice([rng.uniform(-180, 180), 179.0, -179.5]), rng.choice([0.1, 2.0, 6.0])
        for _ in range(rng.randrange(1, 6)):
            point = (max(-90.0, min(90.0, lat + rng.uniform(0, size))), max(-180.0, min(180.0, lon + rng.uniform(0, size))))
            rows.append((f"t{tile:02}", *point, rng.choice([1, 40_000])))
    points = spark.createDataFrame(rows, "_tile string, lat double, lon double, cases int").withColumn("radius_km", merge._radius_km(zoom))
    boxes = merge._boxes(points, "_tile")
    pairs = merge._side(boxes, "l").join(merge._side(boxes, "r"), F.col("l__tile") < F.col("r__tile"))
    got = {(r["l__tile"], r["r__tile"]): r["touches"] for r in merge._decided(pairs, zoom).collect()}
    each = merge._side(points, "l").join(merge._side(points, "r"), F.col("l__tile") < F.col("r__tile"))
    near = each.withColumn("near", merge._points_meet(zoom)).groupBy("l__tile", "r__tile").agg(F.every("near").alias("all"), F.some("near").alias("some"))
    counts = {True: 0, False: 0, None: 0}
    for row in near.collect():
        verdict = got.get((row["l__tile"], row["r__tile"]), False)
        counts[verdict] += 1
        assert verdict is None or (row["all"] if verdict else not row["some"])
    assert counts[False] > counts[None]


@pytest.mark.parametrize("zoom, spread, lat_shift", [(2, 60.0, 0.0), (6, 8.0, 0.0), (10, 0.5, 0.0), (3, 40.0, 70.0)])
def test_near_pairs_and_components(spark, zoom, spread, lat_shift):
    points = [(c, h, min(89.0, lat + lat_shift), lon, n, d, w) for c, h, lat, lon, n, d, w in random_points(zoom, 70, spread)]
    df = spark.createDataFrame(points, POINT)
    pairs = [(r["a_h3"], r["b_h3"]) for r in merge.near_pairs(df, zoom).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs(points, zoom)
    expected = plain_components(list(plain_pairs(points, zoom)) + [(p[1], p[1]) for p in points])
    got = {r["h3"]: r["component"] for r in merge.hotspot_components(merge.collapse_coordinates(df), zoom).collect()}
    assert got == expected
    merged = merge.merge_hotspots(df, zoom)
    assert merged.agg(F.sum("cases")).first()[0] == sum(p[4] for p in points)
    assert merged.count() == len(set(expected.values()))



def test_equal_coordinates_are_summed(spark):
    df = spark.createDataFrame([("c", "b", 1.0, 2.0, 5, "2026-01-01", 1), ("c", "a", 1.0, 2.0, 7, "2026-01-03", 4)], POINT)
    row = merge.collapse_coordinates(df).first()
    assert (row["h3"], row["cases"], row["original_cases"], row["merged_count"], row["latest_date"], row["days_with_cases"]) == (
        "a", 12, 7, 2, "2026-01-03", 4,
    )


# --- quality ---


def test_violations(spark):
    fact = spark.createDataFrame(
        [("2026-01-01", "x", "1"), ("1/2/26", "x", "-1"), (None, "q", "many"), ("2026-01-01", None, "0")], "date_key string, h3 string, case_count string"
    )
    cells = spark.createDataFrame([("x",)], "h3 string")
    counts = dict(rows(quality.violation_counts(quality.fact_violations(fact, cells))))
    assert counts == {"date_format": 2, "case_count": 2, "unknown_cell": 2}


def test_prune_report(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "code string")
    assert rows(quality.prune_report(df, "code", ["a"])) == [(3, 2, 1)]
