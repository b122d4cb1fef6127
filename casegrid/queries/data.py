"""Health-record roles of the driver tables, in Spark and as DuckDB common table expressions.

Integer arithmetic only, so both engines derive the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from casegrid.functions.dates import iso_utc
from casegrid.functions.geo import cell_center, cell_id
from casegrid.operators.gold import gold_fact
from casegrid.session import scratch_path
from casegrid.sources import fhir
from casegrid.sources import gold as gold_store

AS_OF = dt.date(2001, 8, 2)
LATER = dt.date(2003, 1, 15)  # of a second publication: everybody is older
RUN_TIME = dt.datetime(2024, 2, 1, 12, 0, 0)
STAMP = RUN_TIME.isoformat()
RUN_1, RUN_2 = "1706745600000", "1706832000000"  # 2024-02-01 and 2024-02-02, 00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table; its zone-less timestamps are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {
        f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(naive) if naive else df


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    placed = k % 50 != 0
    born = F.date_add(F.lit(dt.date(1930, 1, 1)), ((k * 131) % 26000).cast("int"))
    gender = F.expr(
        "case c_custkey % 6 when 0 then 'male' when 1 then 'F' when 2 then ' M '"
        " when 3 then 'female' when 4 then 'undifferentiated' end"
    )
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            k.cast("string").alias("patient_id"),
            F.col("c_name").alias("name"),
            F.when(k % 97 == 0, "bad").when(k % 89 == 0, "2050-01-01")
            .otherwise(F.date_format(born, "yyyy-MM-dd")).alias("dob"),
            gender.alias("gender"),
            F.col("c_mktsegment").alias("city"),
            F.col("n_name").alias("state"),
            F.lpad((k % 100000).cast("string"), 5, "0").alias("zipcode"),
            F.when(placed, (40000 + (k * 7919) % 4000) / F.lit(1000e0)).alias("latitude"),
            F.when(placed, (-75000 + (k * 104729) % 6000) / F.lit(1000e0)).alias("longitude"),
        )
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("condition_id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.col("o_orderpriority").alias("condition_code"),
        F.concat(F.lit("text "), F.col("o_orderstatus")).alias("condition_text"),
        F.col("o_orderdate").alias("condition_date"),
    )


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_fact(conditions(spark, sf_dir), patients(spark, sf_dir), AS_OF)


def dense_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-grain dates, so that days collect many cases."""
    return conditions(spark, sf_dir).withColumn("condition_date", F.trunc("condition_date", "month").cast("timestamp"))


def dense_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates inside 0.7 degrees, so that cells collect many cases."""
    k = F.col("patient_id").cast("bigint")
    placed = k % 50 != 0
    return patients(spark, sf_dir).withColumns(
        {
            "latitude": F.when(placed, (40000 + (k * 7919) % 700) / F.lit(1000e0)),
            "longitude": F.when(placed, (-75000 + (k * 104729) % 700) / F.lit(1000e0)),
        }
    )


def dense_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_fact(dense_conditions(spark, sf_dir), dense_patients(spark, sf_dir), AS_OF)


def published_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact, written to a fresh Gold folder and read from there: the join and the count run once."""
    root = scratch_path(spark, "gold")
    gold_store.write_fact(fact(spark, sf_dir), root)
    return gold_store.read_fact(spark, root)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to a fresh folder and read from there."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def event_day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact-like rows from the events table: a month of days with many cases each."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("condition_code"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_key"),
        F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("h3"),
        (F.col("event_id") % 3).alias("case_count"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hotspot point per condition and cell of the fact, at the cell centre."""
    cells = fact(spark, sf_dir).groupBy("condition_code", "h3").agg(
        F.sum("case_count").alias("cases"),
        F.max("date_key").alias("latest_date"),
        F.count_distinct("date_key").alias("days_with_cases"),
    )
    lat, lon = cell_center(F.col("h3"))
    return cells.select("*", lat.alias("lat"), lon.alias("lon")).withColumn("original_cases", F.col("cases"))


def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers scattered over the globe, binned into cells of 0.7 degrees per market segment.

    Points are always cells: their number stops growing when every cell is taken.
    """
    k = F.col("c_custkey")
    cell = cell_id(
        ((k * 7919007) % 160000 - 80000) / F.lit(1000e0), ((k * 15485863) % 360000 - 180000) / F.lit(1000e0), 3
    )
    binned = (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_mktsegment").alias("condition_code"), cell.alias("h3"))
        .agg(
            F.sum((k * 37) % 60000 + 1).alias("cases"),
            F.max(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("latest_date"),
            F.max(k % 9 + 1).alias("days_with_cases"),
        )
    )
    lat, lon = cell_center(F.col("h3"))
    return binned.withColumns({"lat": lat, "lon": lon})


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-file columns from suppliers, with unreadable and out-of-range numbers among them."""
    k = F.col("s_suppkey")
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_name").alias("city"),
            F.col("n_name").alias("country"),
            F.when(F.col("n_regionkey") == 1, "US").otherwise("XX").alias("iso2"),
            F.when(k % 11 == 0, "n/a").otherwise((40000 + (k * 7919) % 4000).cast("string")).alias("raw_lat"),
            F.when(k % 11 == 0, "n/a").when(k % 13 == 0, "95.0")
            .otherwise(F.concat((k % 80).cast("string"), F.lit(".5"))).alias("lat"),
            F.concat((k % 170).cast("string"), F.lit(".25")).alias("lng"),
            F.floor(F.col("s_acctbal") * 100e0).cast("string").alias("population"),
        )
        .drop("raw_lat")
    )


# --- Bronze rows --------------------------------------------------------------------------------


def _bronze(df: DataFrame, resource_type: str, resource: Column, resource_id: Column, stamp: Column) -> DataFrame:
    return df.select(
        resource_id.alias("resource_id"),
        stamp.alias("ingestion_timestamp"),
        F.to_json(resource).alias("resource_json"),
        F.lit(resource_type).alias("resource_type"),
    )


def _none(dtype: str = "string") -> Column:
    return F.lit(None).cast(dtype)


def patient_bronze(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> DataFrame:
    people = patients(spark, sf_dir) if people is None else people
    k = F.col("patient_id").cast("bigint")
    resource = fhir.patient_resource(
        F.col("patient_id"), F.col("name"), _none(), F.col("gender"), F.col("dob").try_cast("date"), _none(),
        F.col("city"), F.col("state"), F.col("zipcode"), F.col("latitude"), F.col("longitude"),
        resource_id=F.concat(F.lit("Patient/"), F.col("patient_id")),
    )
    # Spellings of the source gender are kept, unlike in converted CSV files.
    resource = (
        resource.withField("gender", F.col("gender"))
        .withField("telecom", F.array(F.struct(F.concat(F.lit("555-"), F.col("patient_id")).alias("value"))))
        .withField("meta", F.struct(iso_utc(updated_at(k)).alias("lastUpdated")))
    )
    return _bronze(people, "Patient", resource, F.col("patient_id"), F.lit(RUN_TIME).cast("timestamp"))


def updated_at(k: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + k % 86400)


def condition_bronze(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = conditions(spark, sf_dir) if rows is None else rows
    resource = fhir.condition_resource(
        F.col("condition_id"), F.concat(F.lit("Patient/"), F.col("patient_id")), F.lit("Encounter/e1"),
        F.col("condition_date"), _none("timestamp"), F.col("condition_code"), F.col("condition_text"),
        resource_id=F.col("condition_id"),
    )
    stamped = resource.withField(
        "meta", F.struct(iso_utc(updated_at(F.col("condition_id").cast("bigint"))).alias("lastUpdated"))
    )
    return _bronze(rows, "Condition", stamped, F.col("condition_id"), F.lit(RUN_TIME).cast("timestamp"))


def _concept(code: Column, display: Column, text: Column) -> Column:
    return F.struct(
        F.array(F.struct(code.alias("code"), display.alias("display"))).alias("coding"), text.alias("text")
    )


def _ref(kind: str, value: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}/"), value.cast("string")).alias("reference"))


def observation_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    resource = F.struct(
        F.lit("Observation").alias("resourceType"),
        F.concat(F.lit("Observation/"), F.col("event_id").cast("string")).alias("id"),
        _ref("Patient", F.col("user_id")).alias("subject"),
        F.when(F.col("event_id") % 4 != 0, _ref("Encounter", F.col("event_id") % 7)).alias("encounter"),
        _concept(
            F.col("event_type"), F.when(F.col("event_id") % 3 != 0, F.upper("event_type")),
            F.concat(F.lit("free "), F.col("event_type")),
        ).alias("code"),
        F.struct(F.col("value").alias("value"), F.lit("u").alias("unit")).alias("valueQuantity"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("issued"),
    )
    return _bronze(events, "Observation", resource, F.col("event_id").cast("string"), F.col("ts"))


def _line_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def encounter_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    resource = F.struct(
        F.lit("Encounter").alias("resourceType"),
        _line_id().alias("id"),
        _ref("Patient", F.col("l_suppkey")).alias("subject"),
        F.struct(iso_utc(F.col("l_shipdate")).alias("start")).alias("period"),
        F.array(F.struct(_ref("Practitioner", F.col("l_partkey")).alias("individual"))).alias("participant"),
        F.array(
            _concept(
                F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("flag "), "l_returnflag")),
                F.concat(F.lit("text "), F.col("l_returnflag")),
            )
        ).alias("reasonCode"),
    )
    return _bronze(lines, "Encounter", resource, _line_id(), F.col("l_shipdate"))


def medication_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    resource = F.struct(
        F.lit("MedicationRequest").alias("resourceType"),
        _line_id().alias("id"),
        _ref("Patient", F.col("l_suppkey")).alias("subject"),
        _ref("Encounter", F.col("l_orderkey")).alias("encounter"),
        _concept(
            F.col("l_partkey").cast("string"), F.when(F.col("l_linestatus") == "F", F.lit("coded")),
            F.concat(F.lit("text "), F.col("l_returnflag")),
        ).alias("medicationCodeableConcept"),
        F.lower("l_linestatus").alias("status"),
        F.lit("order").alias("intent"),
        iso_utc(F.col("l_shipdate")).alias("authoredOn"),
    )
    return _bronze(lines, "MedicationRequest", resource, _line_id(), F.col("l_shipdate"))


# --- the same in SQL --------------------------------------------------------------------------------

CELL_SQL = (
    "'r4_' || CAST(CAST(least(floor(({lat} + 90) / 0.3515625e0), 511) AS BIGINT) AS VARCHAR) || '_' || "
    "CAST(CAST(least(floor(({lng} + 180) / 0.3515625e0), 1023) AS BIGINT) AS VARCHAR)"
)


def cell_sql(lat: str, lng: str) -> str:
    return CELL_SQL.format(lat=lat, lng=lng)


def centre_sql(cell: str) -> tuple[str, str]:
    part = lambda i: f"CAST(split_part({cell}, '_', {i}) AS DOUBLE)"
    return f"({part(2)} + 0.5e0) * 0.3515625e0 - 90", f"({part(3)} + 0.5e0) * 0.3515625e0 - 180"


AGE_SQL = (
    "CASE WHEN {age} IS NULL OR {age} < 0 OR {age} > 150 THEN 'Unknown' WHEN {age} <= 17 THEN '0-17'"
    " WHEN {age} <= 34 THEN '18-34' WHEN {age} <= 54 THEN '35-54' ELSE '55+' END"
)


def age_sql(dob: str, day: dt.date = AS_OF) -> str:
    born = f"TRY_CAST({dob} AS DATE)"
    age = f"({day.year} - year({born}) - CASE WHEN '{day:%m%d}' < strftime({born}, '%m%d') THEN 1 ELSE 0 END)"
    return AGE_SQL.format(age=age)


def gender_sql(g: str) -> str:
    return (
        f"CASE WHEN lower(trim({g})) IN ('male', 'm') THEN 'male' WHEN lower(trim({g})) IN ('female', 'f') THEN 'female'"
        f" WHEN lower(trim({g})) IN ('other', 'undifferentiated') THEN 'other' ELSE 'unknown' END"
    )


def haversine_sql(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return (
        f"2 * 6371 * asin(sqrt(least(1, power(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat}))"
        f" * cos(radians({b_lat})) * power(sin(radians({b_lon} - {a_lon}) / 2), 2))))"
    )


def fact_sql(condition_table: str, patient_table: str, day: dt.date = AS_OF) -> str:
    return f"""
        SELECT c.condition_code, c.date_key, p.h3, p.age_group, p.gender, count(*) AS case_count,
               min(p.city) AS city, min(p.state) AS state
        FROM {condition_table} c JOIN (
            SELECT patient_id, city, state, {cell_sql('latitude', 'longitude')} AS h3,
                   {age_sql('dob', day)} AS age_group, {gender_sql('gender')} AS gender
            FROM {patient_table} WHERE latitude IS NOT NULL AND longitude IS NOT NULL
        ) p ON p.patient_id = c.patient_id
        GROUP BY ALL"""


_LAT, _LON = centre_sql("h3")

CTES: dict[str, str] = {
    "patients": """
        SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_name AS name,
               CASE WHEN c_custkey % 97 = 0 THEN 'bad' WHEN c_custkey % 89 = 0 THEN '2050-01-01'
                    ELSE CAST(DATE '1930-01-01' + CAST((c_custkey * 131) % 26000 AS INTEGER) AS VARCHAR) END AS dob,
               CASE c_custkey % 6 WHEN 0 THEN 'male' WHEN 1 THEN 'F' WHEN 2 THEN ' M ' WHEN 3 THEN 'female'
                    WHEN 4 THEN 'undifferentiated' END AS gender,
               c_mktsegment AS city, n_name AS state,
               lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zipcode,
               CASE WHEN c_custkey % 50 <> 0 THEN (40000 + (c_custkey * 7919) % 4000) / 1000e0 END AS latitude,
               CASE WHEN c_custkey % 50 <> 0 THEN (-75000 + (c_custkey * 104729) % 6000) / 1000e0 END AS longitude
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "conditions": """
        SELECT CAST(o_orderkey AS VARCHAR) AS condition_id, CAST(o_custkey AS VARCHAR) AS patient_id,
               o_orderpriority AS condition_code, 'text ' || o_orderstatus AS condition_text,
               strftime(o_orderdate, '%Y-%m-%d') AS date_key
        FROM orders""",
    "fact": fact_sql("conditions", "patients"),
    "dense_conditions": """
        SELECT * REPLACE (left(date_key, 8) || '01' AS date_key) FROM conditions""",
    "dense_patients": """
        SELECT * REPLACE (
            CASE WHEN latitude IS NOT NULL THEN (40000 + (CAST(patient_id AS BIGINT) * 7919) % 700) / 1000e0 END AS latitude,
            CASE WHEN latitude IS NOT NULL THEN (-75000 + (CAST(patient_id AS BIGINT) * 104729) % 700) / 1000e0 END AS longitude)
        FROM patients""",
    "dense_fact": fact_sql("dense_conditions", "dense_patients"),
    "event_days": """
        SELECT event_type AS condition_code, strftime(ts, '%Y-%m-%d') AS date_key,
               'c' || CAST(user_id % 40 AS VARCHAR) AS h3, event_id % 3 AS case_count
        FROM events""",
    "points": f"""
        SELECT condition_code, h3, CAST(sum(case_count) AS BIGINT) AS cases, max(date_key) AS latest_date,
               count(DISTINCT date_key) AS days_with_cases, {_LAT} AS lat, {_LON} AS lon
        FROM fact GROUP BY condition_code, h3""",
    "world": """
        WITH w AS (
            SELECT c_mktsegment, c_custkey AS k,
                   CAST(floor((((c_custkey * 7919007) % 160000 - 80000) / 1000e0 + 90) / 0.703125e0) AS BIGINT) AS row,
                   CAST(floor((((c_custkey * 15485863) % 360000 - 180000) / 1000e0 + 180) / 0.703125e0) AS BIGINT) AS col
            FROM customer)
        SELECT c_mktsegment AS condition_code, 'r3_' || CAST(row AS VARCHAR) || '_' || CAST(col AS VARCHAR) AS h3,
               (row + 0.5e0) * 0.703125e0 - 90 AS lat, (col + 0.5e0) * 0.703125e0 - 180 AS lon,
               CAST(sum((k * 37) % 60000 + 1) AS BIGINT) AS cases,
               max('2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')) AS latest_date, max(k % 9 + 1) AS days_with_cases
        FROM w GROUP BY c_mktsegment, row, col""",
    "cities": """
        SELECT s_name AS city, n_name AS country, CASE WHEN n_regionkey = 1 THEN 'US' ELSE 'XX' END AS iso2,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN 95e0
                    ELSE (s_suppkey % 80) + 0.5e0 END AS lat,
               (s_suppkey % 170) + 0.25e0 AS lng,
               CAST(floor(s_acctbal * 100e0) AS BIGINT) AS population
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}
NEEDS = {
    "fact": ["conditions", "patients"],
    "dense_conditions": ["conditions"],
    "dense_patients": ["patients"],
    "dense_fact": ["dense_conditions", "dense_patients"],
    "points": ["fact"],
}


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """The body below the named common table expressions and everything they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    body = body.strip()
    if not ordered:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    rest = ""
    if body.upper().startswith("WITH "):
        rest, body = ", " + body[len("WITH RECURSIVE" if recursive else "WITH"):].strip(), ""
    head = ", ".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest} {body}".strip()
