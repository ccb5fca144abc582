"""Which driver table plays which role.

The operators take column names; these views give the driver's tables the columns the operators
expect. Each view has a twin in SQL (a CTE body) for the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import spread
from ..session import cut_lineage
from .base import table

K = "cast(json_extract_string(props, '$.k') as integer)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


# --- application tables from the event log ---------------------------------------------------
def consents(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'click'").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        F.element_at(F.array(F.lit("care"), F.lit("research"), F.lit("location")), F.col("k") % 3 + 1).alias("purpose"),
        (F.col("k") % 2 == 0).alias("granted"),
        F.col("ts").alias("created_at"),
    )


CONSENTS = f"""consents AS (
  SELECT event_id AS id, 'u' || user_id AS user_id,
         CASE {K} % 3 WHEN 0 THEN 'care' WHEN 1 THEN 'research' ELSE 'location' END AS purpose,
         {K} % 2 = 0 AS granted, ts AS created_at
  FROM events WHERE event_type = 'click')"""


def encounters(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), "user_id").alias("patient_id"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("pr"), F.col("k") % 5)).alias("practitioner_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("draft", "submitted", "reviewed", "emergency")]), F.col("k") % 4 + 1).alias("status"),
        F.when(F.col("value") > 100, "emergency").when(F.col("value") > 50, "urgent").otherwise("routine").alias("triage_level"),
        F.element_at(F.array(*[F.lit(s) for s in ("jangala", "anupa", "sadharana")]), F.col("k") % 3 + 1).alias("desha"),
        F.when(F.dayofmonth("ts") >= 15, "shishira").otherwise("hemanta").alias("ritu"),
        (F.col("k") % 25).alias("top_condition"),
        (F.col("k") % 7 == 0).alias("stopped"),
        F.round(F.col("value") / 500, 4).alias("vata"),
        F.col("ts").alias("created_at"),
    )


ENCOUNTERS = f"""encounters AS (
  SELECT event_id AS id, 'u' || user_id AS patient_id,
         CASE WHEN {K} % 3 <> 0 THEN 'pr' || ({K} % 5) END AS practitioner_id,
         CASE {K} % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'submitted' WHEN 2 THEN 'reviewed' ELSE 'emergency' END AS status,
         CASE WHEN value > 100 THEN 'emergency' WHEN value > 50 THEN 'urgent' ELSE 'routine' END AS triage_level,
         CASE {K} % 3 WHEN 0 THEN 'jangala' WHEN 1 THEN 'anupa' ELSE 'sadharana' END AS desha,
         CASE WHEN day(ts) >= 15 THEN 'shishira' ELSE 'hemanta' END AS ritu,
         {K} % 25 AS top_condition, {K} % 7 = 0 AS stopped, round(value / 500, 4) AS vata,
         ts AS created_at
  FROM events)"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where("event_type = 'purchase'")
    return e.select(
        F.col("event_id").alias("id"),
        F.expr("event_id div 2").alias("encounter_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "revised", "ruled_out", "referred")]), F.col("k") % 4 + 1).alias("decision"),
        F.when(F.col("k") % 10 != 9, F.col("k") % 25).alias("condition_id"),
        F.col("ts").alias("created_at"),
    )


REVIEWS = f"""reviews AS (
  SELECT event_id AS id, event_id // 2 AS encounter_id,
         CASE {K} % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'revised' WHEN 2 THEN 'ruled_out' ELSE 'referred' END AS decision,
         CASE WHEN {K} % 10 <> 9 THEN {K} % 25 END AS condition_id, ts AS created_at
  FROM events WHERE event_type = 'purchase')"""


def daily_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every write to the daily log, several per (user, day)."""
    return events(spark, sf).where("event_type IN ('signup', 'error')").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        F.to_date("ts").alias("day"),
        F.col("k"),
        F.col("value"),
        F.col("ts").alias("written_at"),
    )


DAILY = f"""daily AS (
  SELECT event_id AS id, 'u' || user_id AS user_id, ts::DATE AS day, {K} AS k, value, ts AS written_at
  FROM events WHERE event_type IN ('signup', 'error'))"""

TODAY = "2024-01-28"


# --- condition knowledge base: nations as conditions, brands as symptoms -----------------------
def conditions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per nation: a dimension of fixed size."""
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    return n.select(
        key.alias("condition_id"),
        F.concat(F.lit("C"), (key - key % 8 % 2).cast("string")).alias("name"),
        F.element_at(F.array(*[F.lit(s) for s in ("skin", "ent", "eye", "blood", "other")]), F.col("n_regionkey") + 1).alias("body_system"),
        F.element_at(F.array(*[F.lit(s) for s in ("vata", "pitta", "kapha", "vata-pitta", "vata-kapha", "pitta-kapha", "tridosha")]), key % 7 + 1).alias("dosha"),
        F.when(key % 3 == 0, "difficult").when(key % 3 == 1, "incurable").otherwise("good").alias("prognosis"),
        (key % 5 == 4).alias("profile_conflict"),
        (key % 4 * 15).cast("int").alias("age_low"),
        (key % 4 * 15 + 40).cast("int").alias("age_high"),
        F.when(key % 6 == 5, 0.02).otherwise(1.0).alias("female_weight"),
        F.when(key % 6 == 4, 0.6).otherwise(1.0).alias("male_weight"),
        F.round(1.0 - (key % 5) * 0.1, 4).alias("prior_weight"),
    )


CONDITIONS = """conditions AS (
  SELECT n_nationkey AS condition_id,
         'C' || (n_nationkey - n_nationkey % 8 % 2) AS name,
         CASE n_regionkey WHEN 0 THEN 'skin' WHEN 1 THEN 'ent' WHEN 2 THEN 'eye' WHEN 3 THEN 'blood' ELSE 'other' END AS body_system,
         CASE n_nationkey % 7 WHEN 0 THEN 'vata' WHEN 1 THEN 'pitta' WHEN 2 THEN 'kapha' WHEN 3 THEN 'vata-pitta'
              WHEN 4 THEN 'vata-kapha' WHEN 5 THEN 'pitta-kapha' ELSE 'tridosha' END AS dosha,
         CASE n_nationkey % 3 WHEN 0 THEN 'difficult' WHEN 1 THEN 'incurable' ELSE 'good' END AS prognosis,
         n_nationkey % 5 = 4 AS profile_conflict,
         n_nationkey % 4 * 15 AS age_low, n_nationkey % 4 * 15 + 40 AS age_high,
         CASE WHEN n_nationkey % 6 = 5 THEN 0.02 ELSE 1.0 END::DOUBLE AS female_weight,
         CASE WHEN n_nationkey % 6 = 4 THEN 0.6 ELSE 1.0 END::DOUBLE AS male_weight,
         round(1.0 - (n_nationkey % 5) * 0.1, 4)::DOUBLE AS prior_weight
  FROM nation),
components AS (
  SELECT condition_id, unnest(CASE WHEN dosha = 'tridosha' THEN ['vata','pitta','kapha']
                                   ELSE string_split(dosha, '-') END) AS dosha
  FROM conditions)"""


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    """A nation lists a brand when it buys it at least 5% more often than all nations together.

    The few rows are written, so that a query that uses them often reads the items once.
    """
    items = (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
        .join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    )
    cells = items.groupBy(F.col("c_nationkey").alias("condition_id"), F.col("p_brand").alias("symptom")).agg(
        F.count(F.lit(1)).alias("n")
    )
    by_c = cells.groupBy("condition_id").agg(F.sum("n").alias("n_c"))
    by_s = cells.groupBy("symptom").agg(F.sum("n").alias("n_s"))
    total = cells.agg(F.sum("n").alias("n_all"))
    joined = cells.join(F.broadcast(by_c), "condition_id").join(F.broadcast(by_s), "symptom").join(F.broadcast(total))
    return cut_lineage(joined.where(F.col("n") * F.col("n_all") * 20 >= F.col("n_c") * F.col("n_s") * 21).select("condition_id", "symptom"))


BRIDGE = """cells AS (
  SELECT c_nationkey AS condition_id, p_brand AS symptom, count(*) AS n
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
bridge AS (
  SELECT condition_id, symptom FROM (
    SELECT *, sum(n) OVER (PARTITION BY condition_id) AS n_c, sum(n) OVER (PARTITION BY symptom) AS n_s,
           sum(n) OVER () AS n_all FROM cells)
  WHERE n * n_all * 20 >= n_c * n_s * 21)"""


# --- cases: orders, answering about the brands they contain -------------------------------------
def case_answers(spark: SparkSession, sf: str) -> DataFrame:
    """(case_id, symptom, present)."""
    return (
        table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        .join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .groupBy(F.col("l_orderkey").alias("case_id"), F.col("p_brand").alias("symptom"))
        .agg((F.max("l_quantity") >= 20).alias("present"))
    )


ANSWERS = """answers AS (
  SELECT l_orderkey AS case_id, p_brand AS symptom, max(l_quantity) >= 20 AS present
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 90).cast("int")).alias("age"),
        F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "male").alias("sex"),
        F.to_date("o_orderdate").alias("on_date"),
        F.element_at(F.array(*[F.lit(s) for s in ("jangala", "anupa", "sadharana")]), (F.col("o_custkey") % 3 + 1).cast("int")).alias("habitat"),
    )


CASES = """cases AS (
  SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 90 END AS age,
         CASE o_orderstatus WHEN 'F' THEN 'female' WHEN 'O' THEN 'male' END AS sex,
         o_orderdate::DATE AS on_date,
         CASE o_custkey % 3 WHEN 0 THEN 'jangala' WHEN 1 THEN 'anupa' ELSE 'sadharana' END AS habitat
  FROM orders)"""


# --- cohort with a nullable outcome ----------------------------------------------------------------
def cohort(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    )
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("patient"),
        (F.col("o_custkey") % 63 + 18).cast("int").alias("age"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_nationkey").alias("nation"),
        "c_acctbal",
        "o_totalprice",
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("outcome"),
    )


COHORT = """cohort AS (
  SELECT o_orderkey AS record_id, o_custkey AS patient, o_custkey % 63 + 18 AS age, c_mktsegment AS segment,
         o_orderpriority AS priority, c_nationkey AS nation, c_acctbal, o_totalprice,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


# --- texts -------------------------------------------------------------------------------------------
def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
