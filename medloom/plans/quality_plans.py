"""Quality-gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import quality as q
from . import standins as s
from .base import query, table

ITEMS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_quantity"]
STOP = ", ".join(f"'{w}'" for w in fv.CONFLICT_STOP_WORDS)


@query("dq_duplicate_rate", f"""
SELECT round(sum(n - 1)::DOUBLE / sum(n), 6) AS duplicate_rate
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(ITEMS)})""")
def dq_duplicate_rate(spark, sf):
    return q.duplicate_rate(table(spark, sf, "lineitem"), ITEMS).select(F.round("duplicate_rate", 6).alias("duplicate_rate"))


@query("dq_chance_duplicate_rate")
def dq_chance_duplicate_rate(spark, sf):
    rows = table(spark, sf, "orders")
    return q.chance_duplicate_rate(rows, ["o_orderstatus", "o_orderpriority", "o_orderdate"], "o_orderstatus", "o_orderkey", reps=2)


@query("dq_null_rate", f"""
WITH {s.COHORT}
SELECT round((avg((age IS NULL)::INT) + avg((segment IS NULL)::INT) + avg((priority IS NULL)::INT)
     + avg((outcome IS NULL)::INT)) / 4, 6) AS null_rate FROM cohort""")
def dq_null_rate(spark, sf):
    rows = s.cohort(spark, sf).select("age", "segment", "priority", "outcome")
    return q.null_rate(rows).select(F.round("null_rate", 6).alias("null_rate"))


@query("dq_pii_ratio", """
SELECT 'c_name' AS "column", round(count(DISTINCT c_name)::DOUBLE / count(c_name), 6) AS distinct_ratio,
       count(DISTINCT c_name)::DOUBLE / count(c_name) > 0.5 AS is_identity FROM customer""")
def dq_pii_ratio(spark, sf):
    return q.identity_columns(table(spark, sf, "customer")).withColumn("distinct_ratio", F.round("distinct_ratio", 6))


@query("dq_text_uniqueness", """
SELECT count(DISTINCT text) AS texts, count(DISTINCT source) AS entities,
       round(count(DISTINCT text)::DOUBLE / greatest(count(DISTINCT source), 1), 6) AS uniqueness FROM documents""")
def dq_text_uniqueness(spark, sf):
    return q.text_uniqueness(s.documents(spark, sf), "text", "source").withColumn("uniqueness", F.round("uniqueness", 6))


@query("dq_conflicts", f"""
WITH w AS (
  SELECT DISTINCT doc_id, source, word FROM (
    SELECT doc_id, trim(lower(source)) AS source,
           unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]+')) AS word FROM documents)
  WHERE length(word) > 2 AND word NOT IN ({STOP})),
shared AS (SELECT source, word FROM w GROUP BY ALL HAVING count(*) >= 2),
backed AS (SELECT DISTINCT doc_id FROM w JOIN shared USING (source, word)),
sized AS (SELECT doc_id, trim(lower(source)) AS entity, count(*) OVER (PARTITION BY trim(lower(source))) AS n FROM documents)
SELECT doc_id AS row_id, entity FROM sized WHERE n >= 2 AND doc_id NOT IN (SELECT doc_id FROM backed)""")
def dq_conflicts(spark, sf):
    return q.conflicting_rows(s.documents(spark, sf), "doc_id", "source", "text")


def _mi_sql(feature):
    return f"""SELECT '{feature}' AS feature, round(sum(n / na * ln(n * na / (nx * ny))), 6) AS mi FROM (
      SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny,
             sum(n) OVER ()::DOUBLE AS na
      FROM (SELECT coalesce({feature}::VARCHAR, 'nan') AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL))"""


@query("dq_mutual_information", " UNION ALL ".join(_mi_sql(f) for f in ITEMS if f != "l_returnflag"))
def dq_mutual_information(spark, sf):
    features = [f for f in ITEMS if f != "l_returnflag"]
    return q.mutual_information(table(spark, sf, "lineitem"), features, "l_returnflag").withColumn("mi", F.round("mi", 6))


@query("dq_candidates", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS levels FROM lineitem HAVING count(DISTINCT {c}) BETWEEN 2 AND 50"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", *[i for i in ITEMS if i != "l_returnflag"], "l_extendedprice", "l_shipdate"]))
def dq_candidates(spark, sf):
    return q.candidate_features(table(spark, sf, "lineitem"), "l_returnflag")


@query("dq_noise_features")
def dq_noise_features(spark, sf):
    features = [f for f in ITEMS if f != "l_returnflag"]
    return q.noise_features(table(spark, sf, "lineitem"), features, "l_returnflag", fv.GATE["noise_feature_alpha"])


@query("dq_audit")
def dq_audit(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return q.audit(rows, "customer", "c_custkey", "patient_cohort", "c_mktsegment", reps=1)


@query("dq_verdict", f"""
WITH {s.COHORT}, checks AS (
  SELECT 'cohort' AS source, (avg((age IS NULL)::INT) + avg((outcome IS NULL)::INT)) / 2 <= 0.30 AS passed, true AS blocking FROM cohort
  UNION ALL SELECT 'documents', count(DISTINCT text)::DOUBLE / greatest(count(DISTINCT source), 1) >= 0.20, true FROM documents
  UNION ALL SELECT 'documents', count(DISTINCT text) = 0, false FROM documents
  UNION ALL SELECT 'events', count(DISTINCT props)::DOUBLE / greatest(count(DISTINCT user_id), 1) >= 0.90, true FROM events)
SELECT source, bool_and(passed OR NOT blocking) AS passed FROM checks GROUP BY source""")
def dq_verdict(spark, sf):
    nulls = q.null_rate(s.cohort(spark, sf).select("age", "outcome")).select(
        F.lit("cohort").alias("source"), (F.col("null_rate") <= 0.30).alias("passed"), F.lit(True).alias("blocking"))
    docs = q.text_uniqueness(s.documents(spark, sf), "text", "source")
    unique = docs.select(F.lit("documents").alias("source"), (F.col("uniqueness") >= 0.20).alias("passed"), F.lit(True).alias("blocking"))
    advisory = docs.select(F.lit("documents").alias("source"), (F.col("texts") == 0).alias("passed"), F.lit(False).alias("blocking"))
    props = q.text_uniqueness(s.events(spark, sf), "props", "user_id").select(
        F.lit("events").alias("source"), (F.col("uniqueness") >= 0.90).alias("passed"), F.lit(True).alias("blocking"))
    return q.verdict(nulls.unionByName(unique).unionByName(advisory).unionByName(props))
