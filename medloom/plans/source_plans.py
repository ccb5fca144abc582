"""Source, metadata, questionnaire and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import learning
from ..operators import longitudinal as lo
from ..operators import questionnaires as qu
from ..sources import readers, sinks
from . import standins as s
from .base import query, sql_values, table
from .scoring_plans import terms

_LIMBS = ", ".join(f"('0x' || substr(h, {1 + 15 * i}, 15))::UBIGINT::HUGEINT AS l{i}" for i in range(4))


@query("src_fingerprint", f"""
WITH h AS (SELECT sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)) AS h FROM orders), l AS (SELECT {_LIMBS} FROM h)
SELECT count(*) AS rows, sha256(concat_ws('|', count(*)::VARCHAR, {', '.join(f'sum(l{i})::DECIMAL(38,0)::VARCHAR' for i in range(4))})) AS digest FROM l""")
def src_fingerprint(spark, sf):
    return sinks.fingerprint(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("src_checksums")
def src_checksums(spark, sf):
    return readers.file_digests(spark, [f"{sf}/{n}.parquet" for n in TABLES]).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


@query("src_surrogate_ids", """
SELECT 'CL-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR)::INT), '0') AS condition_id, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""")
def src_surrogate_ids(spark, sf):
    return sinks.surrogate_ids(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "CL", ["o_orderdate", "o_orderkey"], "condition_id").select("condition_id", "o_orderkey")


@query("src_conditions", """
SELECT 'CL-' || lpad(n::VARCHAR, 4, '0') AS condition_id, s_name AS name, 'unspecified' AS body_system, 'vata' AS dosha, '{"text":"' || s_name || '"}' AS reference
FROM (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)
UNION ALL SELECT 'MO-' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR)::INT), '0'), p_name, 'unspecified', CASE WHEN p_size % 2 = 0 THEN 'pitta-kapha' END, '{"text":"' || p_brand || '"}'
FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part)""")
def src_conditions(spark, sf):
    cl = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("Ayurvedic Name"), F.lit("Vata").alias("Dosha Predominance"), F.lit(None).cast("string").alias("System"))
    mo = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("Disease"), F.when(F.col("p_size") % 2 == 0, "Kapha+Pitta").alias("Doshas"), "p_brand")
    left = sinks.condition_rows(cl, "condition_kb_classical", "CL", ["s_suppkey"], {"name": "Ayurvedic Name", "dosha": "Dosha Predominance", "system": "System"}, {"text": "Ayurvedic Name"})
    right = sinks.condition_rows(mo, "condition_kb_modern", "MO", ["p_partkey"], {"name": "Disease", "dosha": "Doshas"}, {"text": "p_brand", "absent": "Formulation"})
    return left.unionByName(right).select("condition_id", "name", "body_system", "dosha", F.col("practitioner_reference").alias("reference"))


@query("src_lineage", """
SELECT 'orders' AS source, (SELECT count(*) FROM orders)::INT AS rows_in, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P')::INT AS rows_out, true AS admitted
UNION ALL SELECT 'documents', (SELECT count(*) FROM documents)::INT, 0, false""")
def src_lineage(spark, sf):
    orders = table(spark, sf, "orders")
    rows = sinks.lineage_rows("run", {"orders": (orders, orders.where("o_orderstatus <> 'P'"), "a", "b", True), "documents": (table(spark, sf, "documents"), None, "c", "d", False)})
    return rows.select("source", "rows_in", "rows_out", "admitted")


@query("src_overlay", """
SELECT s_suppkey AS condition_id, CASE WHEN s_nationkey % 2 = 0 THEN 'N-' || s_suppkey END AS code FROM supplier""")
def src_overlay(spark, sf):
    supplier = table(spark, sf, "supplier")
    links = supplier.where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("condition_id"), F.concat(F.lit("N-"), "s_suppkey").alias("code"))
    return sinks.overlay(supplier.select(F.col("s_suppkey").alias("condition_id")), links)


# --- questionnaires ------------------------------------------------------------------------------------
_QO = [(m, q, o) for m, q, o, _ in fv.MODULE_OPTIONS] + [("manas_prakriti", q, o) for q in fv.MANAS_QUESTIONS for o, _ in fv.MANAS_OPTIONS] + [
    ("ojas_bala", "energy", "invented"), ("dashavidha", "height_cm", None), ("dashavidha", "weight_kg", None)]
_N = len(_QO)
_QSQL = sql_values([(i, *t) for i, t in enumerate(_QO)], "i, module, question, opt", "qo")


def module_answers(spark, sf):
    """Answers from the event log, one per (user, module, question): the latest."""
    from ..functions import dims

    names = dims.dim(spark, [(i, *t) for i, t in enumerate(_QO)], "i int, module string, question string, option string")
    e = s.events(spark, sf).select("event_id", "user_id", ((F.col("event_id") * 31 + F.col("k")) % _N).cast("int").alias("i"), "k")
    rows = e.join(F.broadcast(names), "i").withColumn("number", F.when(F.col("question") == "height_cm", 130 + F.col("k")).when(F.col("question") == "weight_kg", 5 + F.col("k")).cast("double"))
    return lo.latest(rows.select("user_id", "module", "question", "option", "number", "event_id"), ["user_id", "module", "question"], ["event_id"])


ANS = f"""a0 AS (SELECT user_id, module, question, opt, event_id, CASE question WHEN 'height_cm' THEN 130 + k WHEN 'weight_kg' THEN 5 + k END::DOUBLE AS number
  FROM (SELECT event_id, user_id, {s.K} AS k, (event_id * 31 + {s.K}) % {_N} AS i FROM events) JOIN {_QSQL} USING (i)),
a AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, module, question ORDER BY event_id DESC) AS n FROM a0) WHERE n = 1),
ok AS (SELECT * FROM a WHERE (question = 'height_cm' AND number BETWEEN 50 AND 230) OR (question = 'weight_kg' AND number BETWEEN 10 AND 250) OR (number IS NULL AND opt <> 'invented'))"""
_SIG = sql_values([(m, q, o, *[float(sg.get(d, 0.0)) for d in fv.DOSHAS], 0.0, 0.0, 0.0) for m, q, o, sg in fv.MODULE_OPTIONS]
                  + [("manas_prakriti", q, o, 0.0, 0.0, 0.0, *[1.0 if g == gu else 0.0 for g in fv.GUNAS]) for q in fv.MANAS_QUESTIONS for o, gu in fv.MANAS_OPTIONS],
                  "module, question, opt, vata, pitta, kapha, sattva, rajas, tamas", "sg")
_BEST = {}
for _q, _o, _p in fv.OJAS_POINTS:
    _BEST[_q] = max(_p, _BEST.get(_q, 0))
_PTS = sql_values([("ojas_bala", q, o, p, _BEST[q]) for q, o, p in fv.OJAS_POINTS], "module, question, opt, points, best", "pt")


@query("module_scores", f"""
WITH {ANS}, g AS (SELECT user_id, module, count(*) AS answered, sum(coalesce(vata, 0)) AS vata, sum(coalesce(pitta, 0)) AS pitta, sum(coalesce(kapha, 0)) AS kapha, sum(sattva) AS sa, sum(rajas) AS ra, sum(tamas) AS ta,
  sum(points) AS points, sum(best) AS best, max(number) FILTER (WHERE question = 'height_cm') AS h, max(number) FILTER (WHERE question = 'weight_kg') AS w, max(opt) FILTER (WHERE question = 'agni') AS agni
  FROM ok LEFT JOIN {_SIG} USING (module, question, opt) LEFT JOIN {_PTS} USING (module, question, opt) GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN module = 'ojas_bala' AND best > 0 THEN round_even(100.0 * points / best, 0)::BIGINT END AS ojas, round(w / pow(h / 100, 2), 1) AS bmi FROM g)
SELECT user_id, module, answered, round(vata, 6) AS vata, round(pitta, 6) AS pitta, round(kapha, 6) AS kapha, coalesce(ojas, -1) AS ojas_score,
  CASE WHEN ojas >= 70 THEN 'pravara' WHEN ojas >= 40 THEN 'madhyama' WHEN ojas IS NOT NULL THEN 'avara' END AS bala,
  CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 23 THEN 'normal' WHEN bmi < 25 THEN 'overweight' WHEN bmi IS NOT NULL THEN 'obese' END AS pramana,
  CASE WHEN module = 'artava' THEN CASE WHEN greatest(vata, pitta, kapha) > 0 THEN CASE WHEN vata >= greatest(pitta, kapha) THEN 'vata' WHEN pitta >= kapha THEN 'pitta' ELSE 'kapha' END ELSE 'balanced' END END AS pattern,
  CASE WHEN module = 'manas_prakriti' THEN CASE WHEN sa >= greatest(ra, ta) THEN 'sattva' WHEN ra >= ta THEN 'rajas' ELSE 'tamas' END END AS dominant_guna,
  CASE WHEN module = 'manas_prakriti' THEN round(sa / (sa + ra + ta), 3) END AS sattva_share, CASE WHEN module = 'agni_mala' THEN CASE agni WHEN 'irregular' THEN 'vishama' WHEN 'sharp' THEN 'tikshna' WHEN 'slow' THEN 'manda' WHEN 'balanced' THEN 'sama' END END AS agni
FROM x""")
def module_scores(spark, sf):
    accepted, _ = qu.validate(module_answers(spark, sf))
    out = qu.score_modules(accepted)
    return out.select("user_id", "module", "answered", *[F.round(d, 6).alias(d) for d in fv.DOSHAS], F.coalesce("ojas_score", F.lit(-1)).alias("ojas_score"),
                      "bala", "pramana", "pattern", "dominant_guna", "sattva_share", "agni")


@query("module_quarantine", f"WITH {ANS} SELECT event_id, module, question FROM a WHERE event_id NOT IN (SELECT event_id FROM ok)")
def module_quarantine(spark, sf):
    return qu.validate(module_answers(spark, sf))[1].select("event_id", "module", "question")


@query("learning_gate")
def learning_gate(spark, sf):
    conditions, bridge = s.conditions(spark, sf), s.bridge(spark, sf)
    confirmed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 25).cast("int").alias("condition_id"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_custkey") % 90).cast("int").alias("age"), F.lit("female").alias("sex"))
    return learning.gate(confirmed, s.case_answers(spark, sf), conditions, bridge, terms(bridge))
