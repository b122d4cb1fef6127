"""Edge cases of the scalar expressions, with literal expected values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casegrid.functions import dates, demographics, geo, severity, text
from casegrid.sources.fhir import geo_coordinate

V = F.col("v")


def test_canonical_reference(values):
    inputs = ["Patient/1", "urn:uuid:x", "  ", None, "Patient/", " http://h/Patient/7 "]
    assert values(inputs, "string", text.canonical_reference(V)) == ["1", "urn:uuid:x", None, None, "", "7"]


def test_person_name(spark):
    df = spark.createDataFrame([("t", "g", "f"), (None, "g", "f"), (None, None, "f"), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(text.person_name(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["t", "g f", "f", ""]


def test_geo_coordinate(values):
    ext = '{"url":"latitude","valueDecimal":%s}'
    inputs = [
        "{}", ext % "42", ext % "-71.25", '{"url" : "latitude" , "valueDecimal" : 3.5}',
        '{"valueDecimal":1.0,"url":"latitude"}', ext % "1e-5",
    ]
    assert values(inputs, "string", geo_coordinate(V, "latitude")) == [None, 42.0, -71.25, 3.5, None, 1e-5]
    assert values(inputs, "string", geo_coordinate(V, "latitude", parity=True))[-1] == 1.0


def test_timestamps(values):
    inputs = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05-05:00", "2026-01-02", "2026-01", "soon", None]
    got = values(inputs, "string", dates.iso_utc(dates.parse_timestamp(V)))
    assert got == [
        "2026-01-02T03:04:05Z", "2026-01-02T08:04:05Z", "2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z", None, None,
    ]


def test_date_keys(values):
    inputs = ["2026-03-05", "x 2026-03-05T1", "March 5, 2026", "5 Mar 2026", "3/5/2026", "never", "", None]
    expected = ["2026-03-05"] * 5 + [None] * 3
    assert values(inputs, "string", dates.normalize_date_key(V)) == expected
    today = dt.date(2026, 3, 31)
    assert values(["2026-03-01", "never"], "string", dates.shift_date_key(V, -1, today)) == ["2026-02-28", "2026-03-30"]


def test_run_date(values):
    assert values(["1706745600000", "abc", None], "string", dates.run_date(V, dt.date(2020, 1, 2))) == [
        "20240201", "20200102", "20200102",
    ]


def test_age_groups(values):
    as_of = dt.date(2026, 2, 28)
    inputs = ["2000-02-29", "2026-03-01", "1850-01-01", None, "x", "2000-02-29T00:00:00"]
    assert values(inputs, "string", demographics.age_group(V, as_of)) == ["18-34"] + ["Unknown"] * 5
    edges = {17: "0-17", 18: "18-34", 34: "18-34", 35: "35-54", 54: "35-54", 55: "55+", 150: "55+", 151: "Unknown"}
    births = [f"{2026 - age}-02-28" for age in edges]
    assert values(births, "string", demographics.age_group(V, as_of)) == list(edges.values())
    assert values(["2008-03-01"], "string", demographics.age_group(V, as_of)) == ["0-17"]


def test_age_from_other_types(values):
    as_of = dt.date(2026, 2, 28)
    assert values([0, None], "bigint", demographics.age_group(V, as_of, "epoch_ms")) == ["55+", "Unknown"]
    assert values([dt.date(1990, 1, 1)], "date", demographics.age_group(V, as_of, "date")) == ["35-54"]


def test_gender(values):
    inputs = ["M", " f ", "Undifferentiated", "x", None, "\tmale\t", "", "OTHER"]
    assert values(inputs, "string", demographics.normalize_gender(V)) == [
        "male", "female", "other", "unknown", "unknown", "male", "unknown", "other",
    ]


def test_cells(spark):
    nan = float("nan")
    rows = [(90.0, 180.0), (-90.0, -180.0), (nan, 0.0), (None, 0.0), (91.0, 0.0), (0.0, nan), (0.0, 0.0), (10.0, 180.5)]
    df = spark.createDataFrame(rows, "lat double, lng double").withColumn("h3", geo.cell_id(F.col("lat"), F.col("lng")))
    lat, lng = geo.cell_center(F.col("h3"))
    got = [tuple(r) for r in df.select("h3", lat, lng).collect()]
    half = 0.3515625 / 2
    assert got[0] == ("r4_511_1023", 90 - half, 180 - half)
    assert got[1] == ("r4_0_0", -90 + half, -180 + half)
    assert got[6] == ("r4_256_512", half, half)
    assert [g[0] for g in got[2:6]] == [None] * 4 and got[7] == (None, None, None)
    assert geo.cell_count(4) == 524_288


def test_unknown_cell_text_has_no_centre(values):
    lat, _ = geo.cell_center(V)
    assert values(["842a000001ffffffff", "", None], "string", lat) == [None, None, None]


def test_distances(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), geo.longitude_gap(F.lit(179.0), F.lit(-179.0)),
    ).first()
    assert row[0] == pytest.approx(3.141592653589793 * 6371) and row[1] == 2.0


def test_severity(values):
    inputs = [0, 1999, 2000, 15999, 16000, 24999, 25000, None]
    assert values(inputs, "bigint", severity.severity_band(V)) == [0, 0, 1, 5, 6, 6, 7, 0]
    assert values([0, 25000], "bigint", severity.severity_color(V)) == ["#ffff66", "#cc0000"]
    assert values([0, 2], "bigint", severity.center_weight(V)) == [1.0, pytest.approx(2**1.25)]
    thresholds = [severity.base_threshold_km(z) for z in (1, 2, 3, 5, 7, 9, 10)]
    assert thresholds == [900, 900, 650, 240, 50, 15, 5]


def test_json_arrays(values):
    inputs = ['["a", "", 1, null]', "[broken", '{"a": 1}', None]
    assert values(inputs, "string", text.json_string_array(V)) == [["a", "1"], [], [], []]
    assert values([None], "string", text.with_default(text.json_string_array(V), ["x"])) == [["x"]]


def test_codes_and_labels(values):
    assert values(["a/b c", "840539006"], "string", text.safe_code(V)) == ["a_b_c", "840539006"]
    assert values(["male", ""], "string", text.display_label(V)) == ["Male", ""]
    assert values([0, 255], "int", text.surrogate_cell_id(V)) == ["842a000000ffffffff", "842a0000ffffffffff"]


@pytest.mark.parametrize("given, days", [(0, 30), (-5, 1), (181, 180), ("text", 30), ("", 30), (None, 30), (7, 7)])
def test_window(spark, given, days):
    assert dates.clamp_window(given) == days
    text_value = None if given is None else str(given)
    df = spark.createDataFrame([(text_value,)], "v string")
    assert df.select(dates.clamp_window_column(V)).first()[0] == days
