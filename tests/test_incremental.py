"""Buckets, signed rows and commits: results equal those from scratch, and untouched files stay untouched."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from casegrid import schemas, session
from casegrid.operators import dedupe, gold
from casegrid.operators.dedupe import conform
from casegrid.plans import bronze_to_silver as b2s
from casegrid.plans.layout import Layout
from casegrid.plans.silver_to_gold import read_published, refresh_gold, silver_to_gold
from casegrid.sources import bronze, commits, fs
from casegrid.sources import gold as gold_store
from casegrid.sources import silver, state
from test_jobs import RUN_1, RUN_2, T1, T2, condition, land, names, patient

DAY_1, DAY_2 = dt.date(2026, 2, 1), dt.date(2031, 7, 1)


@pytest.fixture
def layout(spark):
    session.apply_settings(spark)
    return Layout(session.scratch_path(spark, "incremental"))


def patient_rows(spark, values):
    """(id, name, updated, lat, dob, city)"""
    df = spark.createDataFrame(values, "patient_id string, name string, at int, latitude double, dob string, city string")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at"))
    return conform(df.withColumns({"source_updated_at": stamp, "longitude": F.lit(20.0), "gender": F.lit("f"), "state": F.col("city")}), schemas.PATIENT)


def condition_rows(spark, values):
    """(id, patient, code, day, text, updated)"""
    df = spark.createDataFrame(values, "condition_id string, patient_id string, condition_code string, day int, condition_text string, at int")
    return conform(
        df.withColumns({
            "source_updated_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at")),
            "condition_date": F.timestamp_seconds(F.lit(1_767_225_600) + 86_400 * F.col("day")),
        }),
        schemas.CONDITION,
    )


def files(spark, path):
    return {b: tuple(fs.files(spark, folder)) for b, folder in silver.manifest(spark, path)["folders"].items()}


def test_a_delta_writes_only_the_buckets_of_its_keys(spark, layout):
    rows = patient_rows(spark, [(f"p{i}", "old", 0, 1.0, None, "c") for i in range(300)])
    first = silver.write_snapshot(rows, layout.silver, "patient", "1")
    second = silver.merge_delta(spark, first, patient_rows(spark, [("p7", "new", 1, 1.0, None, "c")]), layout.silver, "patient", "2")
    before, after = files(spark, first), files(spark, second)
    differ = {b for b in after if after[b] != before[b]}
    assert len(before) == silver.BUCKETS and len(differ) == 1
    assert silver.differing_buckets(spark, first, second) == (differ, True)
    assert set(fs.partition_values(spark, second, silver.BUCKET)) == differ
    changed = silver.open_snapshot(spark, second, "patient").where("name = 'new'")
    assert [r["patient_id"] for r in changed.collect()] == ["p7"]
    # A bucket is one file, written by the task that merged it.
    assert all(len(names) == 1 for b, names in after.items() if b in differ)
    # The first snapshot still reads as it was.
    assert silver.open_snapshot(spark, first, "patient").where("name = 'new'").isEmpty()
    empty = silver.merge_delta(spark, second, rows.limit(0), layout.silver, "patient", "3")
    assert files(spark, empty) == after


def test_merges_by_bucket_equal_the_plain_merge(spark, layout):
    rng, base, path = random.Random(5), None, None
    for run in range(4):
        values = {f"p{rng.randrange(60)}": (rng.choice("abc"), rng.randrange(5), 1.0, None, rng.choice("xy")) for _ in range(25)}
        delta = patient_rows(spark, [(k, *v) for k, v in values.items()])
        path = silver.merge_delta(spark, path, delta, layout.silver, "patient", str(run))
        base = delta if base is None else dedupe.merge_snapshot(base, delta, "patient_id")
        assert sorted(map(str, silver.open_snapshot(spark, path, "patient").collect())) == sorted(map(str, base.collect()))


def test_an_older_run_that_is_landed_again_is_merged(spark, layout):
    land(spark, layout, [patient("a", "old", "2026-01-01T00:00:00Z")], RUN_1, T1)
    land(spark, layout, [patient("b", "B", "2026-01-02T00:00:00Z")], RUN_2, T2)
    b2s.bronze_to_silver(spark, layout, T2)
    df = spark.createDataFrame(
        [patient("a", "repaired", "2026-01-05T00:00:00Z"), patient("n", "new", "2026-01-05T00:00:00Z")],
        "resource_id string, resource_type string, resource_json string",
    )
    bronze.write_bronze(bronze.bronze_rows(df, RUN_1, T2 + dt.timedelta(days=1)), layout.bronze, replace=True)
    assert b2s.bronze_to_silver(spark, layout, T2 + dt.timedelta(days=1)).records == 2
    assert names(spark, layout) == {"a": "repaired", "b": "B", "n": "new"}
    # Files that come later into the same old run: only these are read.
    land(spark, layout, [patient("l", "late", "2026-01-01T00:00:00Z")], RUN_1, T1)
    assert b2s.bronze_to_silver(spark, layout, T2 + dt.timedelta(days=2)).records == 1
    assert names(spark, layout)["l"] == "late"
    assert b2s.bronze_to_silver(spark, layout, T2 + dt.timedelta(days=3)).records == 0


def published(spark, layout):
    return {k: sorted(map(str, df.select(sorted(set(df.columns) - {"generated_at"})).collect())) for k, df in read_published(spark, layout).items()}


def scratch_fact(spark, layout, tables, day):
    """Everything counted from scratch, in a deployment of its own."""
    other = Layout(session.scratch_path(spark, "scratch"))
    state.set_run_state(spark, other.state, b2s.STATE_ID, "1", T1, tables=tables)
    silver_to_gold(spark, other, day, T1)
    return published(spark, other)


@pytest.mark.parametrize("seed", [1])
def test_refreshed_gold_equals_gold_from_scratch(spark, layout, seed):
    rng = random.Random(seed)

    def some_patients(n):
        ids = rng.sample(range(12), n)
        return patient_rows(spark, [
            (f"p{i}", "n", rng.randrange(100), rng.choice([1.0, 1.0, 50.0, None]), rng.choice(["1980-05-01", "1999-01-01", "bad"]), rng.choice(["a", "b", "c", None]))
            for i in ids
        ])

    def some_conditions(n):
        ids = rng.sample(range(60), n)
        return condition_rows(spark, [
            (f"c{i}", f"p{rng.randrange(12)}", rng.choice(["x", "x", "a b/c", f"code {i % 3}", None]), rng.randrange(3), rng.choice(["t", "u", ""]), rng.randrange(100))
            for i in ids
        ])

    tables, day = {}, DAY_1
    for step, (n_patients, n_conditions) in enumerate([(12, 50), (2, 3), (3, 1), (0, 0)]):
        before = dict(tables)
        for table, rows in (("patient", some_patients(n_patients)), ("condition", some_conditions(n_conditions))):
            tables[table] = silver.merge_delta(spark, tables.get(table), rows, layout.silver, table, str(step))
        day = DAY_2 if step >= 2 else DAY_1
        refresh_gold(spark, layout, before, tables, day, T1 + dt.timedelta(hours=step))
        assert published(spark, layout) == scratch_fact(spark, layout, tables, day)


def test_untouched_conditions_are_neither_read_nor_written(spark, layout):
    people = patient_rows(spark, [(f"p{i}", "n", 0, 1.0, "1980-01-01", "a") for i in range(5)])
    codes = ["x", "y", "a b/c"]
    rows = condition_rows(spark, [(f"c{i}", f"p{i % 5}", codes[i % 3], 0, "t", 0) for i in range(30)])
    before = {
        "patient": silver.write_snapshot(people, layout.silver, "patient", "1"),
        "condition": silver.write_snapshot(rows, layout.silver, "condition", "1"),
    }
    first = refresh_gold(spark, layout, {}, before, DAY_1, T1)
    change = condition_rows(spark, [("c2", "p2", "a b/c", 1, "t", 1)])
    after = {**before, "condition": silver.merge_delta(spark, before["condition"], change, layout.silver, "condition", "2")}
    second = refresh_gold(spark, layout, before, after, DAY_1, T2)
    assert fs.partition_values(spark, second, "condition_code") == ["a b%2Fc"]
    folders = gold_store.folders(spark, second)
    assert {f for f in folders.values() if f.startswith(first)} == {gold_store.folders(spark, first)[f"condition_code={c}"] for c in "xy"}
    one = gold_store.open_fact(spark, second, ["a b/c"])
    assert all("version=" + second[-20:] in name for name in one.inputFiles())
    assert "x" not in {r[0] for r in one.select("condition_code").collect()}
    assert gold_store.read_fact(spark, layout.gold).groupBy("condition_code").agg(F.sum("case_count")).count() == 3


def test_a_text_file_is_created_once(spark, layout):
    path, made = f"{layout.root}/commits/1.json", []
    threads = [threading.Thread(target=lambda i=i: made.append((fs.create_text(spark, path, str(i)), str(i)))) for i in range(6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    winners = [text for won, text in made if won]
    assert len(winners) == 1 and fs.read_text(spark, path) == winners[0]
    assert fs.names(spark, f"{layout.root}/commits") == ["1.json"]


def test_of_two_publishers_one_is_refused(spark, layout, monkeypatch):
    base = state.snapshot(spark, layout.state)
    state.publish(spark, layout.state, base, state.run_state_change("a", "1", T1), (state.state_name("a"),))
    # Another name is another matter; the same one has changed.
    state.publish(spark, layout.state, base, state.run_state_change("b", "1", T1), (state.state_name("b"),))
    with pytest.raises(commits.Conflict):
        state.publish(spark, layout.state, base, state.run_state_change("a", "2", T1), (state.state_name("a"),))
    assert state.get_run_state(spark, layout.state, "a") == {"run_ts": "1"}
    # Two whole steps from one state: the one that publishes last is refused and moves no cursor.
    land(spark, layout, [patient("a", "A", "2026-01-01T00:00:00Z")], RUN_1, T1)
    publish = state.publish

    def overtaken(*args, **kwargs):
        monkeypatch.setattr(state, "publish", publish)
        assert b2s.bronze_to_silver(spark, layout, T1).records == 1
        return publish(*args, **kwargs)

    monkeypatch.setattr(state, "publish", overtaken)
    with pytest.raises(commits.Conflict):
        b2s.bronze_to_silver(spark, layout, T2)
    assert names(spark, layout) == {"a": "A"}
    assert b2s.bronze_to_silver(spark, layout, T2).records == 0


def test_readers_open_few_files_of_many_commits(spark, layout, monkeypatch):
    root, now = f"{layout.root}/log", commits.State()
    for i in range(125):
        now = commits.commit(spark, root, now, {f"k{i % 7}": i})
    opened, read_text = [], fs.read_text
    monkeypatch.setattr(fs, "read_text", lambda s, p: opened.append(p) or read_text(s, p))
    assert commits.read(spark, root) == now == commits.State(125, {f"k{i % 7}": i for i in range(125)})
    assert len(opened) <= commits.EVERY + 1
    # A full state that was never written is made up for by the next commit.
    monkeypatch.setattr(commits, "EVERY", 1000)
    for i in range(12):
        now = commits.commit(spark, root, now, {"x": i})
    assert commits.read(spark, root) == now
    monkeypatch.setattr(commits, "EVERY", 10)
    now = commits.commit(spark, root, now, {"x": "last"})
    opened.clear()
    assert commits.read(spark, root) == now and len(opened) == 1
