"""Scalar expressions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid.functions import dates, demographics, geo, severity, text
from casegrid.operators import dedupe, hotspots
from casegrid.operators.quality import keep_allowed, prune_report
from casegrid.queries import data
from casegrid.queries.data import age_sql, cell_sql, centre_sql, gender_sql, haversine_sql, table
from casegrid.queries.registry import query
from casegrid.sources.fhir import geo_coordinate


@query("age_groups", "patients", sql=f"""
    SELECT patient_id, {age_sql('dob')} AS age_group FROM patients""")
def age_groups(spark, sf):
    people = data.patients(spark, sf)
    return people.select("patient_id", demographics.age_group(F.col("dob"), data.AS_OF).alias("age_group"))


@query("gender_norm", "patients", sql=f"""
    SELECT gender, {gender_sql('gender')} AS gender_norm, count(*) AS n FROM patients GROUP BY ALL""")
def gender_norm(spark, sf):
    people = data.patients(spark, sf)
    return people.groupBy("gender", demographics.normalize_gender(F.col("gender")).alias("gender_norm")).agg(
        F.count("*").alias("n")
    )


_COORDS = "(c_custkey * 37 % 200 - 100) * 1e0 AS lat, (c_custkey * 53 % 400 - 200) * 1e0 AS lng"
_CLAT, _CLNG = centre_sql("h3")


@query("cell_bin", sql=f"""
    WITH c AS (SELECT c_custkey, {_COORDS} FROM customer),
    b AS (SELECT c_custkey, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180
                                 THEN {cell_sql('lat', 'lng')} END AS h3 FROM c)
    SELECT c_custkey, h3, {_CLAT} AS cell_lat, {_CLNG} AS cell_lng FROM b""")
def cell_bin(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        geo.cell_id(
            ((k * 37) % 200 - 100).cast("double"), ((k * 53) % 400 - 200).cast("double")
        ).alias("h3"),
    )
    lat, lng = geo.cell_center(F.col("h3"))
    return rows.select("c_custkey", "h3", lat.alias("cell_lat"), lng.alias("cell_lng"))


@query("canonical_ref", sql="""
    WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6
            WHEN 0 THEN 'Patient/' || CAST(l_suppkey AS VARCHAR) WHEN 1 THEN 'urn:uuid:' || CAST(l_suppkey AS VARCHAR)
            WHEN 2 THEN '  ' WHEN 3 THEN NULL WHEN 4 THEN 'Patient/'
            ELSE ' http://x/Patient/' || CAST(l_suppkey AS VARCHAR) || ' ' END AS ref FROM lineitem)
    SELECT ref, CASE WHEN length(trim(ref)) > 0 THEN list_extract(string_split(trim(ref), '/'), -1) END AS id,
           count(*) AS n
    FROM r GROUP BY ALL""")
def canonical_ref(spark, sf):
    ref = F.expr(
        "case l_orderkey % 6 when 0 then concat('Patient/', l_suppkey) when 1 then concat('urn:uuid:', l_suppkey)"
        " when 2 then '  ' when 3 then null when 4 then 'Patient/' else concat(' http://x/Patient/', l_suppkey, ' ') end"
    )
    rows = table(spark, sf, "lineitem").select(ref.alias("ref"))
    return rows.groupBy("ref", text.canonical_reference(F.col("ref")).alias("id")).agg(F.count("*").alias("n"))


@query("safe_code", sql="""
    WITH c AS (SELECT o_orderpriority || '/' || o_orderstatus AS code FROM orders)
    SELECT code, replace(replace(code, '/', '_'), ' ', '_') AS export_name, count(*) AS n FROM c GROUP BY ALL""")
def safe_code(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("code"))
    return rows.groupBy("code", text.safe_code(F.col("code")).alias("export_name")).agg(F.count("*").alias("n"))


@query("date_normalize", sql="""
    WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS date_key,
           strftime(CASE WHEN o_orderkey % 6 = 4 THEN DATE '2001-08-02' ELSE d END - INTERVAL 29 DAY, '%Y-%m-%d') AS start_key
    FROM d""")
def date_normalize(spark, sf):
    raw = F.expr(
        "case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyy-MM-dd')"
        " when 1 then concat(' seen ', date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00:00Z')"
        " when 2 then date_format(o_orderdate, 'MMMM d, yyyy') when 3 then date_format(o_orderdate, 'd MMM yyyy')"
        " when 4 then 'unknown' else date_format(o_orderdate, 'M/d/yyyy') end"
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.normalize_date_key(raw).alias("date_key"),
        dates.shift_date_key(raw, -29, data.AS_OF).alias("start_key"),
    )


@query("json_props", sql="""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           json_extract_string(props, '$.missing[0].x') AS missing FROM events""")
def json_props(spark, sf):
    parsed = F.from_json("props", "k string, missing array<struct<x:string>>")
    return table(spark, sf, "events").withColumn("p", parsed).select(
        "event_id", F.col("p.k").try_cast("bigint").alias("k"), F.get("p.missing", F.lit(0))["x"].alias("missing")
    )


@query("display_coalesce", sql="""
    SELECT l_returnflag, l_linestatus,
           coalesce(CASE WHEN l_linestatus = 'O' THEN 'coded ' || l_returnflag END, 'text ' || l_returnflag) AS display,
           count(*) AS n
    FROM lineitem GROUP BY ALL""")
def display_coalesce(spark, sf):
    coded = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("coded "), "l_returnflag"))
    display = text.first_present(coded, F.concat(F.lit("text "), F.col("l_returnflag")))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", display.alias("display")).agg(
        F.count("*").alias("n")
    )


@query("patient_name", sql="""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Full ' || c_name WHEN 1 THEN c_mktsegment || ' ' || c_name
                                         WHEN 2 THEN c_name ELSE '' END AS name FROM customer""")
def patient_name(spark, sf):
    k = F.col("c_custkey") % 4
    whole = F.when(k == 0, F.concat(F.lit("Full "), "c_name"))
    given = F.when(k == 1, F.col("c_mktsegment"))
    family = F.when(k.isin(1, 2), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.person_name(whole, given, family).alias("name"))


@query("geo_extract", "patients", sql="SELECT patient_id, latitude, longitude FROM patients")
def geo_extract(spark, sf):
    bronze = data.patient_bronze(spark, sf)
    return bronze.select(
        F.col("resource_id").alias("patient_id"),
        geo_coordinate(F.col("resource_json"), "latitude").alias("latitude"),
        geo_coordinate(F.col("resource_json"), "longitude").alias("longitude"),
    )


@query("safe_timestamps", sql="""
    SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL
            WHEN 3 THEN strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ')
            WHEN 2 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%SZ')
            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM events""")
def safe_timestamps(spark, sf):
    raw = F.expr(
        """case event_id % 5 when 4 then concat('at ', event_id) when 3 then date_format(ts, 'yyyy-MM-dd')
           when 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'-05:00'")
           when 1 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end"""
    )
    return table(spark, sf, "events").select("event_id", dates.iso_utc(dates.parse_timestamp(raw)).alias("at"))


@query("iso_text", sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_text(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.iso_utc(F.col("ts")).alias("at"))


@query("run_date", sql="""
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '20010802' ELSE strftime(ts, '%Y%m%d') END AS run_date,
           strftime(ts, '%Y-%m-%d') AS date_key FROM events""")
def run_date(spark, sf):
    run_ts = F.when(F.col("event_id") % 9 == 0, "not-a-run").otherwise(F.unix_millis("ts").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", dates.run_date(run_ts, data.AS_OF).alias("run_date"), dates.date_key(F.col("ts")).alias("date_key")
    )


@query("center_weight", "points", sql="""
    SELECT condition_code, h3, round(power(greatest(1, cases), 1.25e0), 6) AS weight FROM points""")
def center_weight(spark, sf):
    return data.points(spark, sf).select(
        "condition_code", "h3", F.round(severity.center_weight(F.col("cases")), 6).alias("weight")
    )


@query("severity_bands", sql="""
    WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10e0) AS BIGINT) AS cases FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN cases < 2000 THEN 0 WHEN cases < 4000 THEN 1 WHEN cases < 6000 THEN 2
             WHEN cases < 8000 THEN 3 WHEN cases < 12000 THEN 4 WHEN cases < 16000 THEN 5 WHEN cases < 25000 THEN 6
             ELSE 7 END AS BIGINT) AS band,
           CASE WHEN cases < 2000 THEN '#ffff66' WHEN cases < 4000 THEN '#ffee00' WHEN cases < 6000 THEN '#ffcc00'
             WHEN cases < 8000 THEN '#ffaa00' WHEN cases < 12000 THEN '#ff8800' WHEN cases < 16000 THEN '#ff6600'
             WHEN cases < 25000 THEN '#ff3300' ELSE '#cc0000' END AS color,
           least(1e0, cases / 50000e0) AS intensity
    FROM o""")
def severity_bands(spark, sf):
    cases = F.floor(F.col("o_totalprice") / 10e0)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        severity.severity_band(cases).cast("bigint").alias("band"),
        severity.severity_color(cases).alias("color"),
        severity.intensity(cases).alias("intensity"),
    )


@query("radius_thresholds", sql="""
    WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10e0) AS BIGINT) AS cases FROM orders),
    z AS (SELECT unnest([2, 3, 5, 7, 9, 11]) AS zoom),
    t AS (SELECT zoom, exp(-0.62e0 * greatest(0, zoom - 2)) AS scale,
                 900 + 4100 / (1 + exp(0.9e0 * (zoom - 6))) AS low,
                 CASE WHEN zoom <= 2 THEN 900 WHEN zoom <= 3 THEN 650 WHEN zoom <= 5 THEN 240 WHEN zoom <= 7 THEN 50
                      WHEN zoom <= 9 THEN 15 ELSE 5 END AS base FROM z)
    SELECT o_orderkey, CAST(zoom AS BIGINT) AS zoom,
           round(greatest(low, (120000 + least(1, cases / 50000e0) * 180000) * scale) * 1.3e0, 4) AS radius_m,
           CAST(base AS DOUBLE) AS base_km, round(greatest(base, 2 * greatest(low, 300000 * scale) * 1.3e0 / 1000), 4) AS max_km
    FROM o, t""")
def radius_thresholds(spark, sf):
    cases = F.floor(F.col("o_totalprice") / 10e0)
    per_zoom = [
        F.struct(
            F.lit(zoom).cast("bigint").alias("zoom"),
            F.round(severity.radius_m(cases, zoom), 4).alias("radius_m"),
            F.lit(severity.base_threshold_km(zoom)).alias("base_km"),
            F.round(F.lit(severity.max_threshold_km(zoom)), 4).alias("max_km"),
        )
        for zoom in (2, 3, 5, 7, 9, 11)
    ]
    return table(spark, sf, "orders").select("o_orderkey", F.inline(F.array(*per_zoom)))


@query("distances", "patients", sql=f"""
    SELECT patient_id, round({haversine_sql('latitude', 'longitude', '-33.5e0', '170.25e0')}, 6) AS km,
           CASE WHEN abs(longitude - 170.25e0) > 180 THEN 360 - abs(longitude - 170.25e0)
                ELSE abs(longitude - 170.25e0) END AS lon_gap
    FROM patients""")
def distances(spark, sf):
    here = F.col("latitude"), F.col("longitude")
    there = F.lit(-33.5), F.lit(170.25)
    return data.patients(spark, sf).select(
        "patient_id",
        F.round(geo.haversine_km(*here, *there), 6).alias("km"),
        geo.longitude_gap(here[1], there[1]).alias("lon_gap"),
    )


@query("labels", sql="""
    SELECT event_type, upper(left(event_type, 1)) || substr(event_type, 2) AS label, count(*) AS n
    FROM events GROUP BY ALL""")
def labels(spark, sf):
    return table(spark, sf, "events").groupBy(
        "event_type", text.display_label(F.col("event_type")).alias("label")
    ).agg(F.count("*").alias("n"))


@query("composite_id", sql="""
    SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS id
    FROM lineitem""")
def composite_id(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", text.composite_id(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")).alias("id")
    )


@query("metadata_arrays", sql="""
    SELECT event_id, CASE event_id % 4
             WHEN 0 THEN event_type || ',' || CAST(user_id AS VARCHAR)
             ELSE '0-17,18-34,35-54,55+,Unknown' END AS members,
           CAST(CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS given
    FROM events""")
def metadata_arrays(spark, sf):
    raw = F.expr(
        """case event_id % 4 when 0 then concat('["', event_type, '", "", ', user_id, ', null]')
           when 1 then '[broken' when 2 then '{"a": 1}' end"""
    )
    given = text.json_string_array(raw)
    return table(spark, sf, "events").select(
        "event_id",
        F.array_join(text.with_default(given, hotspots.schemas.AGE_GROUPS), ",").alias("members"),
        F.size(given).cast("bigint").alias("given"),
    )


@query("alias_schema", sql="""
    SELECT event_type AS condition_code, strftime(ts, '%Y-%m-%d') AS date_key, 'u' || CAST(user_id AS VARCHAR) AS h3,
           CAST(sum(event_id % 5) AS BIGINT) AS case_count
    FROM events GROUP BY ALL""")
def alias_schema(spark, sf):
    written = table(spark, sf, "events").select(
        F.col("event_type").alias("Condition"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("H3"),
        (F.col("event_id") % 5).cast("int").alias("CaseCount"),
    )
    return hotspots.canonical_fact(written).groupBy("condition_code", "date_key", "h3").agg(
        F.sum("case_count").alias("case_count")
    )


@query("metadata_values", sql="""
    SELECT event_type AS code, CASE WHEN event_id % 3 = 0 THEN 'shown' ELSE event_type END AS display,
           CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE 7 END AS patient_count
    FROM events WHERE event_id % 10 <> 9""")
def metadata_values(spark, sf):
    written = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 10 == 9, "  ").otherwise(F.col("event_type")).alias("condition"),
        F.when(F.col("event_id") % 3 == 0, " shown ").otherwise(" ").alias("display_name"),
        F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 5).cast("string")).otherwise("n/a").alias("patient_count"),
        F.lit("7").alias("case_count"),
    )
    return hotspots.conditions_metadata(written)


@query("blank_drop", sql="""
    SELECT 'u' || CAST(user_id AS VARCHAR) AS h3, CAST(count(*) AS BIGINT) AS n, CAST(user_id AS DOUBLE) AS latitude
    FROM events WHERE event_id % 3 = 0 GROUP BY user_id""")
def blank_drop(spark, sf):
    written = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
        .when(F.col("event_id") % 3 == 1, " ").alias("h3_id"),
        F.col("user_id").cast("string").alias("lat"),
    )
    return hotspots.cells_metadata(written).groupBy("h3", "latitude").agg(F.count("*").alias("n"))


@query("not_null_filters", "patients", sql="""
    SELECT patient_id, latitude, longitude FROM patients WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
def not_null_filters(spark, sf):
    from casegrid.operators.gold import located_patients

    people = data.patients(spark, sf)
    located = located_patients(people, data.AS_OF).select("patient_id")
    return people.join(located, "patient_id", "left_semi").select("patient_id", "latitude", "longitude")


@query("text_match", sql="""
    SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'covid') OR contains(lower(text), 'the')""")
def text_match(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(text.mentions_any(F.col("text"), ["COVID", "the"])).select("doc_id", "n_chars")


@query("allowlist_prune", sql="""
    WITH v AS (SELECT DISTINCT o_orderpriority AS code FROM orders)
    SELECT count(*) AS scanned, count(*) FILTER (code NOT IN ('1-URGENT', '5-LOW')) AS deleted,
           count(*) FILTER (code IN ('1-URGENT', '5-LOW')) AS kept,
           (SELECT count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) AS kept_rows
    FROM v""")
def allowlist_prune(spark, sf):
    orders, allowed = table(spark, sf, "orders"), ["1-URGENT", "5-LOW"]
    kept = keep_allowed(orders, "o_orderpriority", allowed).agg(F.count("*").alias("n"))
    return prune_report(orders, "o_orderpriority", allowed).withColumn("kept_rows", kept.scalar())


@query("gold_conform", sql="""
    SELECT o_orderpriority AS condition_code, CAST(NULL AS VARCHAR) AS city, CAST(count(*) AS BIGINT) AS n,
           CAST(sum(CAST(o_custkey AS INTEGER)) AS BIGINT) AS case_count
    FROM orders GROUP BY o_orderpriority""")
def gold_conform(spark, sf):
    from casegrid import schemas

    generator_rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("condition_code"), F.col("o_custkey").cast("int").alias("case_count")
    )
    rows = dedupe.conform(generator_rows, schemas.GOLD_FACT)
    return rows.groupBy("condition_code", "city").agg(
        F.count("*").alias("n"), F.sum("case_count").alias("case_count")
    )


@query("window_bounds", sql="""
    SELECT event_id, CAST(CASE WHEN event_id % 7 IN (0, 1, 2) THEN 30
             ELSE greatest(1, least(180, event_id % 400 - 100)) END AS BIGINT) AS days
    FROM events WHERE event_id % 7 IN (0, 1, 2) OR event_id % 400 <> 100
    UNION ALL SELECT event_id, 30 FROM events WHERE event_id % 7 NOT IN (0, 1, 2) AND event_id % 400 = 100""")
def window_bounds(spark, sf):
    raw = F.expr(
        "case event_id % 7 when 0 then '0' when 1 then ' ' when 2 then 'month' else string(event_id % 400 - 100) end"
    )
    return table(spark, sf, "events").select("event_id", dates.clamp_window_column(raw).cast("bigint").alias("days"))


@query("audit_columns", sql="""
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at, '2024-02-01T12:00:00Z' AS updated_at FROM events""")
def audit_columns(spark, sf):
    from casegrid.sources.fhir import extract_observations

    rows = extract_observations(data.observation_bronze(spark, sf), data.RUN_TIME)
    return rows.select(
        F.col("obs_id").cast("bigint").alias("event_id"),
        dates.iso_utc(F.col("created_at")).alias("created_at"),
        dates.iso_utc(F.col("updated_at")).alias("updated_at"),
    )
