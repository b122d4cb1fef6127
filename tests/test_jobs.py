"""Jobs end to end on small inputs: reruns, missing types, failures between steps, batch = stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from casegrid import session
from casegrid.plans import bronze_to_silver as b2s
from casegrid.plans.csv_to_fhir import csv_to_fhir
from casegrid.plans.layout import Layout
from casegrid.plans.silver_to_gold import silver_to_gold
from casegrid.sources import bronze, csvs, exports, fhir, fs, gold, silver, state
from casegrid.streaming.incremental import stream_gold, stream_silver

AS_OF = dt.date(2026, 2, 28)
T1, T2 = dt.datetime(2026, 2, 1, 6), dt.datetime(2026, 2, 2, 6)
RUN_1, RUN_2 = "1769904000000", "1769990400000"


def patient(pid, name, updated, lat=10.0, born="1980-01-01"):
    geo = [{"url": "latitude", "valueDecimal": lat}, {"url": "longitude", "valueDecimal": 20.0}]
    body = {
        "resourceType": "Patient", "id": pid, "name": [{"text": name}], "birthDate": born, "gender": "F",
        "address": [{"city": "C", "state": "S", "extension": [{"url": fhir.GEO_URL, "extension": geo}]}],
        "meta": {"lastUpdated": updated},
    }
    return pid, "Patient", json.dumps({k: v for k, v in body.items() if v is not None})


def condition(cid, pid, code="840539006", day="2026-01-05"):
    body = {
        "resourceType": "Condition", "id": cid, "subject": {"reference": f"Patient/{pid}"},
        "code": {"coding": [{"code": code, "display": "COVID-19"}]}, "recordedDate": f"{day}T03:00:00Z",
        "meta": {"lastUpdated": "2026-01-06T00:00:00Z"},
    }
    return cid, "Condition", json.dumps(body)


def land(spark, layout, resources, run_ts, at):
    df = spark.createDataFrame(resources, "resource_id string, resource_type string, resource_json string")
    bronze.write_bronze(bronze.bronze_rows(df, run_ts, at), layout.bronze)


@pytest.fixture
def layout(spark):
    session.apply_settings(spark)
    return Layout(session.scratch_path(spark, "test"))


def names(spark, layout):
    return {r["patient_id"]: r["name"] for r in b2s.silver_table(spark, layout, "patient").collect()}


def test_incremental_runs(spark, layout):
    first = [patient("a", "A", "2026-01-01T00:00:00Z"), patient("b", "B", "2026-01-09T00:00:00Z"), condition("x", "a"),
             ("z", "Patient", "{broken"), patient(None, "keyless", "2026-01-01T00:00:00Z")]
    land(spark, layout, first, RUN_1, T1)
    done = b2s.bronze_to_silver(spark, layout, T1)
    assert done.run_ts == RUN_1 and done.records == 5
    assert names(spark, layout) == {"a": "A", "b": "B"}
    assert spark.read.parquet(f"{layout.rejects}/patient").count() == 2
    # An older version of b arrives late; a is renamed; conditions do not arrive at all.
    land(spark, layout, [patient("a", "A2", "2026-01-20T00:00:00Z"), patient("b", "B0", "2026-01-02T00:00:00Z")], RUN_2, T2)
    done = b2s.bronze_to_silver(spark, layout, T2)
    assert "condition" in done.carried_forward and done.records == 2
    assert names(spark, layout) == {"a": "A2", "b": "B"}
    assert b2s.silver_table(spark, layout, "condition", RUN_2).count() == 1
    # Nothing new: the same state again.
    again = b2s.bronze_to_silver(spark, layout, T2 + dt.timedelta(hours=1))
    assert again.records == 0 and again.tables == done.tables
    assert [r["job_name"] for r in state.latest_jobs(state.read_log(spark, layout.state, "jobs"), 2).collect()] == ["bronze_to_silver"] * 2


def test_failure_before_the_cursor_moves_is_repeated(spark, layout, monkeypatch):
    land(spark, layout, [patient("a", "A", "2026-01-01T00:00:00Z")], RUN_1, T1)
    with monkeypatch.context() as patch:
        patch.setattr(state, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            b2s.bronze_to_silver(spark, layout, T1)
    assert state.get_run_cursors(spark, layout.state, ["patient"]) == {}
    jobs = state.latest_jobs(state.read_log(spark, layout.state, "jobs"), 1).first()
    assert (jobs["status"], jobs["error_message"]) == ("failed", "lost")
    assert b2s.bronze_to_silver(spark, layout, T1).records == 1
    assert names(spark, layout) == {"a": "A"}


def test_every_landed_run_is_merged_once(spark, layout):
    land(spark, layout, [patient("a", "A", "2026-01-01T00:00:00Z"), patient(None, "keyless", "2026-01-01T00:00:00Z")], RUN_1, T1)
    land(spark, layout, [patient("b", "B", "2026-01-02T00:00:00Z")], RUN_2, T2)
    land(spark, layout, [patient("c", "C", "2026-01-02T00:00:00Z")], "by-hand", T2 + dt.timedelta(days=3))
    assert bronze.latest_run(spark, layout.bronze) == RUN_2
    assert b2s.bronze_to_silver(spark, layout, T2).records == 4
    assert names(spark, layout) == {"a": "A", "b": "B", "c": "C"}
    assert b2s.bronze_to_silver(spark, layout, T2).records == 0
    quality = {(r["metric"], r["value"]) for r in state.read_log(spark, layout.state, "quality").collect()}
    assert ("rejects", 1.0) in quality and ("rows", 4.0) in quality
    # A run that is named is read whole, merged or not, and changes nothing a second time.
    assert b2s.bronze_to_silver(spark, layout, T2, RUN_1).records == 2
    assert names(spark, layout) == {"a": "A", "b": "B", "c": "C"}


def test_gold_readers_see_one_publication(spark, layout, monkeypatch):
    from casegrid.plans.silver_to_gold import read_published, silver_to_gold
    from casegrid.sources import gold as gold_store

    land(spark, layout, [patient("a", "A", "2026-01-01T00:00:00Z"), condition("x", "a")], RUN_1, T1)
    b2s.bronze_to_silver(spark, layout, T1)
    silver_to_gold(spark, layout, dt.date(2026, 2, 1), T1)
    land(spark, layout, [condition("y", "a", "other")], RUN_2, T2)
    b2s.bronze_to_silver(spark, layout, T2)
    with monkeypatch.context() as patch:
        patch.setattr(gold_store, "write_dimension", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            silver_to_gold(spark, layout, dt.date(2026, 2, 1), T2)
    codes = lambda name: {r[0] for r in read_published(spark, layout)[name].select("condition_code").collect()}
    assert codes("fact") == codes(gold_store.CONDITIONS) == {"840539006"}
    silver_to_gold(spark, layout, dt.date(2026, 2, 1), T2)
    assert codes("fact") == codes(gold_store.CONDITIONS) == {"840539006", "other"}


def test_pages_to_bronze_job(spark, layout, tmp_path):
    from casegrid.plans.pages_to_bronze import pages_to_bronze

    def page(name, *resources):
        body = {"resourceType": "Bundle", "entry": [{"resource": json.loads(r[2])} for r in resources]}
        (tmp_path / name).write_text(json.dumps(body))

    page("1.json", patient("a", "A", "2026-01-01T00:00:00Z"), condition("x", "a"))
    page("2.json", patient("b", "B", "2026-01-05T00:00:00Z"))
    for _ in range(2):  # landed again, the run replaces itself
        done = pages_to_bronze(spark, layout, str(tmp_path), RUN_1, T1, "p1")
        assert done.records == 3 and bronze.read_bronze(spark, layout.bronze, run_ts=RUN_1).count() == 3
    assert state.get_cursors(spark, layout.state, ["pages_to_bronze:Patient"]) == {"pages_to_bronze:Patient": dt.datetime(2026, 1, 5)}
    assert b2s.bronze_to_silver(spark, layout, T1).records == 3
    with pytest.raises(Exception):
        pages_to_bronze(spark, layout, str(tmp_path / "absent"), RUN_2, T2, "p2")
    runs = {r["id"]: r["status"] for r in state.current_runs(state.read_log(spark, layout.state, "runs")).collect()}
    assert runs == {"p1": "completed", "p2": "failed"}
    assert state.get_run_state(spark, layout.state, "bronze_latest_run")["run_ts"] == RUN_1


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    from casegrid.sources.csvs import read_csv

    head = "city,country,iso2,lat,lng,population"
    (tmp_path / "a.csv").write_text(f'{head}\nA,X,x,1,2,3\n"line\nbreak",X,x,1,2,3\n')
    (tmp_path / "b.csv").write_text("country,city,population,lat,lng,iso2,extra\nY,B,3,1,2,y,e\n")
    got = {(r["city"], r["country"]) for r in read_csv(spark, str(tmp_path), "worldcities").collect()}
    assert got == {("A", "X"), ("line\nbreak", "X"), ("B", "Y")}


def test_null_groups_and_one_large_group(spark):
    from casegrid.operators import allocate, ranking
    from pyspark.sql import functions as F

    rows = [(None, i, 0.1 * (i % 7 + 1), 10) for i in range(9)] + [("g", i, 1 / 3, 7) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, w double, t bigint").repartition(4)
    runs = [sorted(map(str, allocate.allocate(df, ["g"], "w", "t", ["i"]).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    sums = {r["g"]: r["n"] for r in allocate.allocate(df, ["g"], "w", "t", ["i"]).groupBy("g").agg(F.sum("allocated").alias("n")).collect()}
    assert sums == {None: 10, "g": 7}
    shares = allocate.weight_share(df, ["g"], "w").groupBy("g").agg(F.round(F.sum("share"), 6).alias("s")).collect()
    assert {r["g"]: r["s"] for r in shares} == {None: 1.0, "g": 1.0}
    assert ranking.position_ratio(df, [F.col("i")], ["g"]).count() == 209


def test_gold_is_idempotent_and_parity_keeps_old_keys(spark, layout):
    land(spark, layout, [patient("a", "A", "2026-01-01T00:00:00Z"), condition("x", "a"), condition("y", "a", "a b/c")], RUN_1, T1)
    b2s.bronze_to_silver(spark, layout, T1)
    results = []
    for _ in range(2):
        silver_to_gold(spark, layout, AS_OF, T1)
        results.append(sorted(map(tuple, gold.read_fact(spark, layout.gold).collect())))
    assert results[0] == results[1] and len(results[0]) == 2
    # The patient turns into another age group: replaced by default, kept beside the old one in parity mode.
    later = dt.date(2040, 2, 28)
    silver_to_gold(spark, layout, later, T2, parity=True)
    assert gold.read_fact(spark, layout.gold).count() == 4
    silver_to_gold(spark, layout, later, T2)
    assert {r["age_group"] for r in gold.read_fact(spark, layout.gold).collect()} == {"55+"}
    dim = {r["condition_code"]: r["patient_count"] for r in gold.read_dimension(spark, layout.gold, gold.CONDITIONS).collect()}
    assert dim == {"840539006": 1, "a b/c": 1}
    assert gold.read_fact(spark, layout.gold, "a b/c").count() == 1


def test_only_one_snapshot_is_read(spark, layout):
    empty = silver.empty(spark, "patient")
    assert silver.read_current(spark, layout.silver, "patient") is None
    silver.write_snapshot(empty, layout.silver, "patient", "900")
    silver.write_snapshot(empty.limit(0), layout.silver, "patient", "1000")
    assert silver.snapshot_runs(spark, layout.silver, "patient") == ["900", "1000"]
    first = silver.snapshot_path(spark, layout.silver, "patient", "1000")
    silver.write_snapshot(empty, layout.silver, "patient", "1000")
    assert silver.snapshot_path(spark, layout.silver, "patient", "1000") > first
    assert silver.read_snapshot(spark, layout.silver, "patient", "5") is None


def test_missing_type_and_unknown_type(spark, layout):
    land(spark, layout, [("1", None, "{}"), ("2", "Patient", "{}")], RUN_1, T1)
    assert bronze.read_bronze(spark, layout.bronze, "Condition", RUN_1).count() == 0
    assert bronze.read_bronze(spark, layout.bronze, "Unknown").count() == 1
    assert bronze.latest_run(spark, layout.bronze) == RUN_1
    assert bronze.read_bronze(spark, layout.bronze + "-absent").count() == 0
    assert fs.partition_values(spark, layout.bronze, "resource_type") == ["Patient", "Unknown"]


def test_export_refuses_colliding_names(spark, layout):
    fact = spark.createDataFrame([("a/b", 1), ("a_b", 2)], "condition_code string, case_count bigint")
    with pytest.raises(ValueError, match="a_b"):
        gold.export_fact(fact, f"{layout.root}/export")


def test_bundle_pages(spark, layout, tmp_path):
    entries = [{"resource": {"resourceType": "Patient", "id": "p", "v": 1.5}}, {"search": {}}, {"resource": {"id": "q"}}]
    (tmp_path / "page1.json").write_text(json.dumps({"resourceType": "Bundle", "entry": entries, "link": []}, indent=1))
    (tmp_path / "page2.json").write_text('{"resourceType":"Bundle"}')
    got = fhir.explode_bundles(fhir.read_bundle_pages(spark, str(tmp_path))).orderBy("resource_id").collect()
    assert [(r["resource_id"], r["resource_type"]) for r in got] == [("p", "Patient"), ("q", "Unknown")]
    assert json.loads(got[0]["resource_json"])["v"] == 1.5


def test_many_bundle_pages_in_a_file(spark, layout, tmp_path):
    text = lambda *ids: json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"id": i, "note": "a\nb"}} for i in ids]}, indent=1)
    pages = spark.createDataFrame([(text("a", "b"),), (text("c"),), (text(),)], "bundle_json string")
    fhir.write_bundle_pages(pages.coalesce(1), str(tmp_path / "pages"))
    (tmp_path / "pages" / "alone.json").write_text(text("d"))
    assert len(fs.files(spark, str(tmp_path / "pages"))) == 2
    got = fhir.explode_bundles(fhir.read_bundle_pages(spark, str(tmp_path / "pages"))).collect()
    assert sorted((r["resource_id"], json.loads(r["resource_json"])["note"]) for r in got) == [(i, "a\nb") for i in "abcd"]


def test_pages_are_landed_in_few_files(spark, layout, tmp_path, monkeypatch):
    from casegrid.queries import QUERIES, medallion

    roots = {}
    monkeypatch.setattr(medallion, "scratch_path", lambda spark, name: roots.setdefault(name, str(tmp_path / name)))
    orders = spark.range(3000).selectExpr(
        "id * 7 as o_orderkey", "id as o_custkey", "'O' as o_orderstatus", "timestamp_ntz'1999-01-01' as o_orderdate",
        "if(id % 2 = 0, '1-URGENT', '5-LOW') as o_orderpriority",
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["pages_to_bronze"](spark, str(tmp_path)).collect()
    assert len(got) == len({r["resource_id"] for r in got}) == 3000 and all(r["at_cursor"] for r in got)
    assert len(fs.files(spark, roots["page-files"])) <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # of 210 pages


def test_latest_source_time(spark):
    df = spark.createDataFrame([(patient("a", "A", "2026-01-01T00:00:00-05:00")[2],), ("{}",)], "resource_json string")
    assert fhir.latest_source_time(df, None).first()[0] == dt.datetime(2026, 1, 1, 5)
    assert fhir.latest_source_time(df.limit(0), T1).first()[0] == T1


def test_csv_to_fhir(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION\n'
        '2020-01-01,2020-01-03,p1,e1,840539006,"COVID-19, ""confirmed"""\n'
        '2020-01-11,,p1,e1,,suspected Covid\n2020-01-05,,p2,e1,1,covid\n2020-01-05,,,e1,1,covid\n2020-01-05,,p1,e1,1,flu\n'
    )
    conditions = csvs.read_csv(spark, str(tmp_path / "c.csv"), "conditions").withColumn("source_index", F.monotonically_increasing_id() + 1)
    patients = spark.createDataFrame([("p1", "Ava", "Diaz", "F", "1980-02-29", "1 St", "C", "S", "02458", "42.5", "bad")],
                                     ", ".join(f"{c} string" for c in csvs.CSV_COLUMNS["patients"]))
    encounters = spark.createDataFrame([("e1", "2020-01-06T00:00:00Z", "2020-01-01T00:00:00Z", " amb ", "99", None)],
                                       ", ".join(f"{c} string" for c in csvs.CSV_COLUMNS["encounters"]))
    target = (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 11))
    result = csv_to_fhir(conditions, patients, encounters, target)
    assert result.selected.count() == 3 and result.dropped.count() == 1
    first, second = [json.loads(r["bundle_json"]) for r in result.bundles.orderBy("source_index").collect()]
    p, e, c = [entry["resource"] for entry in first["entry"]]
    assert [x["request"]["method"] for x in first["entry"]] == ["PUT", "PUT", "POST"]
    assert p["name"] == [{"given": ["Ava"], "family": "Diaz", "text": "Ava Diaz"}] and p["gender"] == "unknown"
    assert p["birthDate"] == "1980-02-29" and "extension" not in p["address"][0]
    assert e["class"]["code"] == "AMB" and e["type"][0]["text"] == "Encounter" and e["type"][0]["coding"][0]["code"] == "99"
    assert e["period"] == {"start": "2026-01-06T00:00:00Z"}
    assert c["recordedDate"] == "2026-01-01T00:00:00Z" and c["abatementDateTime"] == "2026-01-03T00:00:00Z"
    assert c["code"]["text"] == 'COVID-19, "confirmed"' and c["subject"]["reference"] == first["entry"][0]["fullUrl"]
    other = second["entry"][2]["resource"]
    assert other["code"]["coding"][0]["code"] == "840539006" and "abatementDateTime" not in other
    assert other["recordedDate"] == "2026-01-11T00:00:00Z"
    assert csv_to_fhir(conditions, patients, encounters, target, max_records=1).bundles.count() == 1


def test_metadata_lines(spark):
    dim = spark.createDataFrame([("b", "B", 2, "t", 2, "[]", "[]"), ("a", "A", 1, "t", 2, "[]", "[]")], gold.schemas.CONDITIONS_DIM)
    lines = exports.conditions_lines(dim, "now").collect()
    assert {r["condition_code"]: (r["condition_display"], r["total_unique"]) for r in lines} == {"a": ("A", 2), "b": ("B", 2)}
    cells = spark.createDataFrame([("x", 1.0, 2.0, "t", 1)], gold.schemas.CELLS_DIM)
    assert exports.cells_lines(cells, "now").first()["latitude"] == 1.0


def test_run_summary_keeps_first_creation(spark, layout):
    state.record_run(spark, layout.state, "r", T1, status="running", run_ts=RUN_1)
    state.record_run(spark, layout.state, "r", T2, status="completed", completed_at=T2)
    row = state.current_runs(state.read_log(spark, layout.state, "runs")).first()
    assert (row["status"], row["run_ts"], row["created_at"], row["last_update"]) == ("completed", RUN_1, T1, T2)
    assert state.get_run_state(spark, layout.state, "absent") is None


def test_stream_equals_batch(spark, layout):
    other = Layout(layout.root + "-batch")
    clock = iter(T1 + dt.timedelta(minutes=i) for i in range(100))
    batches = [
        [patient("a", "A", "2026-01-01T00:00:00Z"), patient("b", "B", "2026-01-01T00:00:00Z", lat=30.0), condition("x", "a"), condition("y", "b")],
        [patient("b", "B2", "2026-01-09T00:00:00Z", lat=50.0), condition("z", "a", day="2026-01-07")],
    ]
    for run_ts, at, batch in zip((RUN_1, RUN_2), (T1, T2), batches):
        for target in (layout, other):
            land(spark, target, batch, run_ts, at)
        query = stream_gold(spark, layout, layout.root + "/checkpoint", AS_OF, clock=lambda: next(clock))
        query.awaitTermination()
        assert query.exception() is None
        b2s.bronze_to_silver(spark, other, at, run_ts)
        silver_to_gold(spark, other, AS_OF, at)
        streamed, batched = (sorted(map(tuple, gold.read_fact(spark, x.gold).collect())) for x in (layout, other))
        assert streamed == batched
    assert names(spark, layout) == names(spark, other) == {"a": "A", "b": "B2"}


def test_stream_batch_is_applied_once(spark, layout):
    from casegrid.streaming import incremental

    land(spark, layout, [patient("a", "A", "2026-01-01T00:00:00Z")], RUN_1, T1)
    query = stream_silver(spark, layout, layout.root + "/checkpoint", clock=lambda: T1)
    query.awaitTermination()
    before = state.get_run_state(spark, layout.state, b2s.STATE_ID)
    rows = bronze.read_bronze(spark, layout.bronze)
    incremental._apply_batch(rows, before["batch_id"], layout, "bronze", lambda: T2)
    assert state.get_run_state(spark, layout.state, b2s.STATE_ID) == before
