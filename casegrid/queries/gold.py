"""Silver -> Gold: the fact, its upserts and the dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrid import schemas
from casegrid.operators import deltas, gold, hotspots
from casegrid.operators.dedupe import add_missing, conform, union_all
from casegrid.queries import data
from casegrid.queries.data import centre_sql
from casegrid.queries.registry import query

_LAT, _LNG = centre_sql("h3")


@query("gold_fact", "fact", sql="SELECT * FROM fact")
def gold_fact(spark, sf):
    return data.fact(spark, sf)


@query("gold_fact_dense", "dense_fact", sql="SELECT * FROM dense_fact")
def gold_fact_dense(spark, sf):
    return data.dense_fact(spark, sf)


@query("demographic_join", "patients", "conditions", sql="""
    SELECT c.condition_code, p.state, count(*) AS n
    FROM conditions c JOIN patients p USING (patient_id) WHERE p.latitude IS NOT NULL GROUP BY ALL""")
def demographic_join(spark, sf):
    joined = gold.demographic_join(
        gold.dated_conditions(data.conditions(spark, sf)), gold.located_patients(data.patients(spark, sf), data.AS_OF)
    )
    return joined.groupBy("condition_code", "state").agg(F.count("*").alias("n"))


_UPSERT = """
    WITH new AS (SELECT condition_code, date_key, h3, age_group, gender, case_count + 100 AS case_count, city, state
                 FROM fact WHERE date_key >= '1998-01-01'),
    old AS (SELECT * FROM fact WHERE date_key < '2000-01-01')
    SELECT * FROM new UNION ALL
    SELECT * FROM old o WHERE NOT EXISTS (
        SELECT 1 FROM new n WHERE n.condition_code = o.condition_code AND n.date_key = o.date_key AND n.h3 = o.h3
                              AND n.age_group = o.age_group AND n.gender = o.gender)"""


@query("gold_upsert", "fact", sql=_UPSERT)
def gold_upsert(spark, sf):
    """Overlapping halves of the fact: matching keys take the new count, all others stay."""
    fact = data.fact(spark, sf)
    new = fact.where("date_key >= '1998-01-01'").withColumn("case_count", F.col("case_count") + 100)
    return gold.upsert_fact(fact.where("date_key < '2000-01-01'"), new)


@query("gold_refresh", "patients", "conditions", sql=f"""
    WITH moved AS (SELECT * REPLACE (CASE WHEN CAST(patient_id AS BIGINT) % 7 = 0 THEN latitude + 1 ELSE latitude END AS latitude)
                   FROM patients),
    kept AS (SELECT * FROM conditions WHERE CAST(condition_id AS BIGINT) % 11 <> 0)
    {data.fact_sql('kept', 'moved', data.LATER)}""")
def gold_refresh(spark, sf):
    """Patients move and age, conditions vanish: signed rows move the counts, emptied groups go."""
    people, rows = data.patients(spark, sf), data.conditions(spark, sf)
    k = F.col("patient_id").cast("bigint")
    moved = people.withColumn("latitude", F.when(k % 7 == 0, F.col("latitude") + 1).otherwise(F.col("latitude")))
    kept = rows.where(F.col("condition_id").cast("bigint") % 11 != 0)
    existing, after = data.published_fact(spark, sf), gold.located_patients(moved, data.LATER)
    changes = deltas.signed_cases(
        deltas.signed_changes(deltas.condition_forms(rows), deltas.condition_forms(kept)),
        deltas.signed_changes(gold.located_patients(people, data.AS_OF), after),
        gold.dated_conditions(rows), after,
    )
    changes = data.written(changes, "changes")
    lost = data.written(deltas.lost_places(existing, changes), "lost")
    return deltas.apply_changes(existing, changes, deltas.recounted_places(lost, kept, moved, data.LATER))


@query("conditions_dim", "fact", "conditions", sql="""
    WITH texts AS (SELECT condition_code, condition_text, count(*) AS n FROM conditions GROUP BY ALL),
    best AS (SELECT condition_code, condition_text FROM (
        SELECT *, row_number() OVER (PARTITION BY condition_code ORDER BY n DESC, condition_text) AS rn FROM texts) WHERE rn = 1),
    totals AS (SELECT condition_code, CAST(sum(case_count) AS BIGINT) AS patient_count FROM fact GROUP BY condition_code)
    SELECT t.condition_code, b.condition_text AS condition_display, t.patient_count, '2024-02-01T12:00:00' AS generated_at,
           CAST((SELECT count(*) FROM totals) AS INTEGER) AS total_unique,
           '["0-17", "18-34", "35-54", "55+", "Unknown"]' AS age_groups_json,
           '["male", "female", "other", "unknown"]' AS genders_json
    FROM totals t LEFT JOIN best b USING (condition_code)""")
def conditions_dim(spark, sf):
    labels = gold.condition_labels(data.conditions(spark, sf))
    return gold.conditions_dim(data.fact(spark, sf), data.STAMP, labels)


@query("true_patient_count", "patients", "conditions", sql="""
    SELECT condition_code, count(DISTINCT patient_id) AS true_patient_count
    FROM conditions JOIN patients USING (patient_id) WHERE latitude IS NOT NULL GROUP BY condition_code""")
def true_patient_count(spark, sf):
    return gold.true_patient_counts(data.conditions(spark, sf), data.patients(spark, sf), data.AS_OF)


@query("cells_dim", "fact", sql=f"""
    WITH c AS (SELECT DISTINCT h3 FROM fact)
    SELECT h3, {_LAT} AS latitude, {_LNG} AS longitude, '2024-02-01T12:00:00' AS generated_at,
           CAST((SELECT count(*) FROM c) AS INTEGER) AS total_unique FROM c""")
def cells_dim(spark, sf):
    return gold.cells_dim(data.fact(spark, sf), data.STAMP)


@query("distinct_dims", "fact", sql="""
    SELECT 'condition' AS kind, condition_code AS value FROM fact GROUP BY condition_code
    UNION ALL SELECT 'cell', h3 FROM fact GROUP BY h3""")
def distinct_dims(spark, sf):
    fact = data.fact(spark, sf)
    values = lambda kind, c: fact.select(F.lit(kind).alias("kind"), F.col(c).alias("value")).distinct()
    return values("condition", "condition_code").unionByName(values("cell", "h3"))


@query("new_cells", "fact", sql=f"""
    WITH old AS (SELECT DISTINCT h3 FROM fact WHERE date_key < '1995-03-01'), now AS (SELECT DISTINCT h3 FROM fact)
    SELECT h3, 1.5e0 AS latitude, 2.5e0 AS longitude FROM old
    UNION ALL SELECT h3, {_LAT}, {_LNG} FROM now WHERE h3 NOT IN (SELECT h3 FROM old)""")
def new_cells(spark, sf):
    fact = data.fact(spark, sf)
    old = fact.where("date_key < '1995-03-01'").select("h3").distinct().select(
        "h3", F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude")
    )
    return add_missing(old, gold.cells_dim(fact, data.STAMP).select("h3", "latitude", "longitude"), ["h3"])


@query("overview", "fact", sql="""
    SELECT count(DISTINCT condition_code) AS total_conditions, CAST(sum(case_count) AS BIGINT) AS total_cases,
           CAST(sum(case_count) AS BIGINT) AS total_patients, count(DISTINCT h3) AS total_cells,
           '2024-02-01T12:00:00' AS generated_at
    FROM fact""")
def overview(spark, sf):
    fact = data.fact(spark, sf)
    return hotspots.overview(gold.conditions_dim(fact, data.STAMP), gold.cells_dim(fact, data.STAMP))


@query("schema_union", "fact", sql="""
    SELECT condition_code, date_key, h3, age_group, gender, case_count, NULL AS city, NULL AS state FROM fact WHERE date_key < '1998-01-01'
    UNION ALL SELECT * FROM fact WHERE date_key >= '1998-01-01'""")
def schema_union(spark, sf):
    """An older table without place columns, below a newer one."""
    fact = data.fact(spark, sf)
    old = fact.where("date_key < '1998-01-01'").drop("city", "state")
    return conform(union_all(old, fact.where("date_key >= '1998-01-01'")), schemas.GOLD_FACT)
