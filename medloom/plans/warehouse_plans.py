"""Star-schema, aggregate, ordering and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import warehouse as w
from . import standins as s
from .base import query, table


@query("star_overview", """
WITH p AS (SELECT c_nationkey AS k, count(*) AS customers, avg(c_acctbal) AS mean_balance,
                  avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS share_building FROM customer GROUP BY 1),
a AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
c AS (SELECT c_nationkey AS k, count(*) AS orders, avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END) AS share_finished
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT n_nationkey AS nation, n_name, customers, round(mean_balance, 4) AS mean_balance, round(share_building, 6) AS share_building,
       suppliers, orders, round(share_finished, 6) AS share_finished
FROM nation LEFT JOIN p ON p.k = n_nationkey LEFT JOIN a ON a.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey ORDER BY 1""")
def star_overview(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    customer = table(spark, sf, "customer")
    patients = customer.select(F.col("c_nationkey").alias("nation"), "c_acctbal", "c_mktsegment")
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    # Orders shrink to one row per customer before meeting the customer table.
    per_customer = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("fo"))
    orders = per_customer.join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    return w.overview(nations, "nation", [
        (patients, [F.count(F.lit(1)).alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"),
                    F.round(F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)), 6).alias("share_building")]),
        (suppliers, [F.count(F.lit(1)).alias("suppliers")]),
        (orders, [F.sum("n").alias("orders"), F.round(F.sum("f") / F.sum("fo"), 6).alias("share_finished")]),
    ], "nation")


CLUSTERS = "clusters AS (SELECT DISTINCT p_brand AS symptom, CAST(replace(p_brand, 'Brand#', '') AS INT) % 6 - 1 AS cluster_id FROM part)"


def symptom_clusters(spark, sf):
    number = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    return table(spark, sf, "part").select(F.col("p_brand").alias("symptom"), (number % 6 - 1).alias("cluster_id")).distinct()


@query("cluster_by_system", f"""
WITH {s.CONDITIONS}, {s.BRIDGE}, {CLUSTERS}
SELECT cluster_id, body_system, count(DISTINCT condition_id) AS conditions
FROM bridge JOIN clusters USING (symptom) JOIN conditions USING (condition_id) WHERE cluster_id >= 0 GROUP BY 1, 2""")
def cluster_by_system(spark, sf):
    return w.cluster_by_system(s.bridge(spark, sf), symptom_clusters(spark, sf), s.conditions(spark, sf))


@query("profiles_nested", f"""
WITH {s.CONDITIONS}, {s.BRIDGE}
SELECT condition_id, name, body_system, array_to_string(list_sort(list(DISTINCT symptom)), '|') AS symptoms
FROM conditions JOIN bridge USING (condition_id) WHERE NOT profile_conflict GROUP BY 1, 2, 3""")
def profiles_nested(spark, sf):
    return w.nested_profiles(s.conditions(spark, sf), s.bridge(spark, sf)).select(
        "condition_id", "name", "body_system", F.array_join("symptoms", "|").alias("symptoms"))


@query("kpis", """
SELECT (SELECT count(*) FROM customer) AS patients, (SELECT count(*) FROM orders) AS assessments,
       (SELECT count(*) FROM lineitem) AS answers, (SELECT count(DISTINCT p_brand) FROM part) AS symptoms,
       (SELECT count(*) FROM supplier WHERE s_nationkey IN (1, 2)) AS coded""")
def kpis(spark, sf):
    return w.kpis({
        "patients": table(spark, sf, "customer"), "assessments": table(spark, sf, "orders"),
        "answers": table(spark, sf, "lineitem"), "symptoms": table(spark, sf, "part").select("p_brand").distinct(),
        "coded": table(spark, sf, "supplier").where("s_nationkey IN (1, 2)"),
    })


ENRICH = """rows_in AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE -1 END AS cluster,
  CASE o_custkey % 5 WHEN 0 THEN 'vata' WHEN 1 THEN 'pitta-kapha' WHEN 2 THEN 'tridosha' WHEN 3 THEN 'kapha' END AS dosha FROM orders),
known AS (SELECT cluster, dosha, (dosha IN ('vata', 'tridosha'))::INT AS vata, (dosha IN ('pitta-kapha', 'tridosha'))::INT AS pitta,
          (dosha IN ('pitta-kapha', 'tridosha', 'kapha'))::INT AS kapha FROM rows_in WHERE cluster >= 0 AND dosha IS NOT NULL)"""


def enrichment_rows(spark, sf):
    p, k = F.col("o_orderpriority"), F.col("o_custkey") % 5
    return table(spark, sf, "orders").select(
        F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2).when(p == "5-LOW", 3).otherwise(-1).alias("cluster"),
        F.when(k == 0, "vata").when(k == 1, "pitta-kapha").when(k == 2, "tridosha").when(k == 3, "kapha").alias("dosha"))


@query("enrichment_lift", f"""
WITH {ENRICH}, long AS (
  SELECT cluster, 'vata' AS component, vata AS hit FROM known UNION ALL SELECT cluster, 'pitta', pitta FROM known
  UNION ALL SELECT cluster, 'kapha', kapha FROM known)
SELECT cluster, component, n, round(hits / n, 6) AS share, round(hits / n / (all_hits / all_n), 6) AS lift
FROM (SELECT cluster, component, count(*) AS n, sum(hit)::DOUBLE AS hits, sum(sum(hit)) OVER (PARTITION BY component)::DOUBLE AS all_hits,
             sum(count(*)) OVER (PARTITION BY component)::DOUBLE AS all_n FROM long GROUP BY 1, 2)""")
def enrichment_lift(spark, sf):
    out = w.enrichment(enrichment_rows(spark, sf), "cluster", "dosha")
    return out.select("cluster", "component", "n", F.round("share", 6).alias("share"), F.round("lift", 6).alias("lift"))


@query("enrichment_fisher", f"""
WITH {ENRICH}, long AS (
  SELECT cluster, 'vata' AS component, vata AS hit FROM known UNION ALL SELECT cluster, 'pitta', pitta FROM known
  UNION ALL SELECT cluster, 'kapha', kapha FROM known),
c AS (SELECT cluster, component, count(*) AS n, sum(hit) AS a, sum(sum(hit)) OVER (PARTITION BY component) AS k,
             sum(count(*)) OVER (PARTITION BY component) AS t FROM long GROUP BY 1, 2),
x AS (SELECT *, unnest(generate_series(a::BIGINT, least(n, k)::BIGINT)) AS i FROM c),
p AS (SELECT cluster, component, least(1.0, sum(exp(lgamma(n + 1) + lgamma(t - n + 1) + lgamma(k + 1) + lgamma(t - k + 1) - lgamma(t + 1)
      - lgamma(i + 1) - lgamma(n - i + 1) - lgamma(k - i + 1) - lgamma(t - n - k + i + 1)))) AS p FROM x WHERE t - n - k + i >= 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY p, cluster, component) AS rk, count(*) OVER () AS m FROM p)
SELECT cluster, component, round(p, 4) AS p_value,
       round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 4) AS q_value FROM r""")
def enrichment_fisher(spark, sf):
    out = w.enrichment(enrichment_rows(spark, sf), "cluster", "dosha")
    return out.select("cluster", "component", F.round("p_value", 4).alias("p_value"), F.round("q_value", 4).alias("q_value"))


LLR = """base AS (SELECT d, avg((x.condition_id IS NOT NULL)::INT)::DOUBLE AS base FROM
   (SELECT condition_id AS cid FROM conditions WHERE NOT profile_conflict) CROSS JOIN (SELECT unnest(['vata','pitta','kapha']) AS d)
   LEFT JOIN components x ON x.condition_id = cid AND x.dosha = d GROUP BY 1),
having_s AS (SELECT symptom, condition_id FROM bridge JOIN conditions USING (condition_id) WHERE NOT profile_conflict),
llr AS (SELECT symptom, d AS dosha, round(ln(p / (1 - p)) - ln(base / (1 - base)), 4) AS llr FROM (
   SELECT symptom, d, base, (count(x.condition_id) + 5.0 * base) / (count(*) + 5.0) AS p
   FROM having_s h CROSS JOIN base LEFT JOIN components x ON x.condition_id = h.condition_id AND x.dosha = d GROUP BY 1, 2, 3))"""


@query("llr_table", f"WITH {s.CONDITIONS}, {s.BRIDGE}, {LLR} SELECT symptom, dosha, llr FROM llr")
def llr_table(spark, sf):
    return w.dosha_llr(s.bridge(spark, sf), s.conditions(spark, sf))


@query("climate_cells", """
WITH r AS (SELECT l_suppkey AS cell, year(l_shipdate) AS year, CASE WHEN l_linenumber <> 3 THEN floor(l_quantity) / 4 END AS rain,
           CASE WHEN l_returnflag <> 'A' THEN 70 + l_linenumber + floor(l_quantity) / 16 END AS rh, floor(l_quantity) / 2 AS t FROM lineitem)
SELECT cell, year, p AS annual_precip_mm, h AS mean_rh, t AS mean_temp_c,
       CASE WHEN p > 1500 OR h > 78 THEN 'anupa' WHEN p < 750 THEN 'jangala' ELSE 'sadharana' END AS habitat
FROM (SELECT cell, year, round_even(sum(coalesce(rain, 0)), 1) AS p, round_even(avg(rh), 1) AS h, round_even(avg(t), 1) AS t FROM r GROUP BY 1, 2)""")
def climate_cells(spark, sf):
    q = F.floor("l_quantity")
    r = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.year("l_shipdate").cast("long").alias("year"),
        F.when(F.col("l_linenumber") != 3, q / 4).alias("rain"),
        F.when(F.col("l_returnflag") != "A", 70 + F.col("l_linenumber") + q / 16).alias("rh"), (q / 2).alias("t"))
    return w.climate_cells(r, ["cell", "year"], "rain", "rh", "t")


@query("climate_stale", """
WITH cache AS (SELECT o_custkey AS cell, max(o_orderdate) AS fetched_at FROM orders GROUP BY 1)
SELECT c_custkey AS cell FROM customer WHERE c_custkey NOT IN (SELECT cell FROM cache WHERE fetched_at > TIMESTAMP '2001-06-30' - INTERVAL 365 DAY)""")
def climate_stale(spark, sf):
    cache = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.max("o_orderdate").alias("fetched_at"))
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"))
    return w.stale_cells(wanted, cache, F.lit("2001-06-30").cast("timestamp_ntz"))


@query("mode_median", f"""
WITH {s.COHORT}, m AS (SELECT segment, count(*) AS n FROM cohort GROUP BY 1), q AS (SELECT priority, count(*) AS n FROM cohort GROUP BY 1)
SELECT (SELECT segment FROM m ORDER BY n DESC, segment LIMIT 1) AS segment, (SELECT priority FROM q ORDER BY n DESC, priority LIMIT 1) AS priority,
       (SELECT quantile_cont(age, 0.5) FROM cohort)::DOUBLE AS age, (SELECT round(quantile_cont(o_totalprice, 0.5), 4) FROM cohort) AS o_totalprice""")
def mode_median(spark, sf):
    out = w.reference_row(s.cohort(spark, sf), ["segment", "priority"], ["age", "o_totalprice"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("cluster_topn", """
WITH sized AS (SELECT l_orderkey AS condition_id, count(DISTINCT l_partkey) AS n_symptoms FROM lineitem GROUP BY 1)
SELECT condition_id, cluster_id, n_symptoms, position FROM (
  SELECT o_orderkey AS condition_id, o_orderpriority AS cluster_id, n_symptoms,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY n_symptoms DESC, o_orderkey) AS position
  FROM orders JOIN sized ON condition_id = o_orderkey) WHERE position <= 10""")
def cluster_topn(spark, sf):
    sizes = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy(
        F.col("l_orderkey").alias("condition_id")).agg(F.count(F.lit(1)).alias("n_symptoms"))
    conditions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("condition_id"), F.col("o_orderpriority").alias("cluster_id"))
    return w.top_conditions(conditions, sizes).withColumn("position", F.col("position").cast("long"))


@query("newest_n", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 200")
def newest_n(spark, sf):
    return w.newest(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_id", 200)


@query("consensus_rank", """
WITH t AS (SELECT l_quantity, count(*) AS a, round(avg(l_discount), 3) AS b, sum(l_linenumber) AS c FROM lineitem GROUP BY 1),
r AS (SELECT l_quantity, round((rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0
     + rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0
     + rank() OVER (ORDER BY c DESC) + (count(*) OVER (PARTITION BY c) - 1) / 2.0) / 3, 9) AS m FROM t)
SELECT l_quantity, rank() OVER (ORDER BY m) AS consensus_rank FROM r""")
def consensus_rank(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("a"), F.round(F.avg("l_discount"), 3).alias("b"), F.sum("l_linenumber").alias("c"))
    return w.consensus_rank(t, ["a"], ["b", "c"]).select("l_quantity", F.col("consensus_rank").cast("long").alias("consensus_rank"))


@query("set_union", """
SELECT 'CL-' || s_suppkey AS condition_id, s_name AS name, s_nationkey::VARCHAR AS system, NULL AS herb FROM supplier
UNION ALL SELECT 'MO-' || p_partkey, p_name, NULL, p_brand FROM part""")
def set_union(spark, sf):
    left = table(spark, sf, "supplier").select(
        F.concat(F.lit("CL-"), "s_suppkey").alias("condition_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("system"))
    right = table(spark, sf, "part").select(
        F.concat(F.lit("MO-"), "p_partkey").alias("condition_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("herb"))
    return w.union_bases(left, right)


@query("set_first_wins", """
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256(lower(text)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def set_first_wins(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2(F.lower("text"), 256).alias("h"))
    return w.first_by(rows, F.col("h"), ["doc_id"]).drop("h")


@query("set_algebra", f"""
WITH {s.ANSWERS}, {s.CONDITIONS}, {s.BRIDGE},
prof AS (SELECT condition_id, list(symptom) AS profile FROM bridge GROUP BY 1),
a AS (SELECT case_id, coalesce(list(symptom) FILTER (WHERE present), []) AS yes, coalesce(list(symptom) FILTER (WHERE NOT present), []) AS no FROM answers GROUP BY 1)
SELECT case_id, array_to_string(list_sort(list_filter(yes, lambda x: list_contains(profile, x))), ',') AS supporting,
       array_to_string(list_sort(list_filter(no, lambda x: list_contains(profile, x))), ',') AS denied_typical,
       array_to_string(list_sort(list_filter(yes, lambda x: NOT list_contains(profile, x))), ',') AS unexplained,
       array_to_string(list_sort(list_filter(profile, lambda x: NOT list_contains(yes, x) AND NOT list_contains(no, x)))[1:6], ',') AS not_yet_asked
FROM a JOIN prof ON condition_id = case_id % 25""")
def set_algebra(spark, sf):
    answers = s.case_answers(spark, sf).groupBy("case_id").agg(
        F.collect_set(F.when(F.col("present"), F.col("symptom"))).alias("yes"),
        F.collect_set(F.when(~F.col("present"), F.col("symptom"))).alias("no"))
    profiles = s.bridge(spark, sf).groupBy("condition_id").agg(F.collect_set("symptom").alias("profile"))
    joined = answers.withColumn("condition_id", (F.col("case_id") % 25).cast("int")).join(F.broadcast(profiles), "condition_id")
    return joined.select("case_id", *[F.array_join(c, ",").alias(n) for c, n in zip(
        w.evidence_sets(F.col("profile"), F.col("yes"), F.col("no")), ("supporting", "denied_typical", "unexplained", "not_yet_asked"))])
