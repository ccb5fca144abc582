"""Selection, association and risk-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import bayes, risk
from ..operators import scoring as sc
from ..operators import selection as sel
from ..operators import warehouse as wh
from . import standins as s
from .base import query, table
from .quality_plans import ITEMS

FEATURES = [f for f in ITEMS if f != "l_returnflag"]


def _pair_sql(f1, f2):
    return f"""SELECT '{f1}' AS f1, '{f2}' AS f2, round(sum(n / na * ln(n * na / (nx * ny))), 6) AS joint_mi FROM (
      SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY x1, x2)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny, sum(n) OVER ()::DOUBLE AS na
      FROM (SELECT {f1} AS x1, {f2} AS x2, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL))"""


@query("jmi_pairs", " UNION ALL ".join(_pair_sql(FEATURES[i], FEATURES[j]) for i in range(5) for j in range(i + 1, 5)))
def jmi_pairs(spark, sf):
    return sel.pair_information(table(spark, sf, "lineitem"), FEATURES, "l_returnflag").withColumn("joint_mi", F.round("joint_mi", 6))


@query("jmi_rank")
def jmi_rank(spark, sf):
    order = sel.jmi_rank(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return spark.createDataFrame([(i, f) for i, f in enumerate(order)], "position int, feature string")


def order_labels(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"))


def order_cells(spark, sf):
    return s.case_answers(spark, sf).select(F.col("case_id").alias("row_id"), F.col("symptom").alias("term"))


OC = """oc AS (SELECT DISTINCT l_orderkey AS row_id, p_brand AS term FROM lineitem JOIN part ON p_partkey = l_partkey),
ol AS (SELECT o_orderkey AS row_id, o_orderpriority AS label FROM orders)"""
MI1 = """ny AS (SELECT label AS y, count(*)::DOUBLE AS ny FROM ol GROUP BY 1), n1 AS (SELECT term, y, coalesce(count(oc.row_id), 0)::DOUBLE AS n1 FROM (SELECT DISTINCT term FROM oc) CROSS JOIN ny
  LEFT JOIN ol ON label = y LEFT JOIN oc USING (row_id, term) GROUP BY 1, 2),
x AS (SELECT term, y, '1' AS x, n1 AS n FROM n1 UNION ALL SELECT term, y, '0', ny - n1 FROM n1 JOIN ny USING (y)),
mi AS (SELECT term, sum(CASE WHEN n > 0 THEN n / t * ln(n * t / (nx * ny)) ELSE 0 END) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY term, x) AS nx, sum(n) OVER (PARTITION BY term, y) AS ny, sum(n) OVER (PARTITION BY term) AS t FROM x) GROUP BY 1)"""


@query("sparse_information", f"WITH {OC}, {MI1} SELECT term, round(mi, 8) AS mi FROM mi")
def sparse_information(spark, sf):
    return sel.sparse_pair_cells(order_cells(spark, sf), order_labels(spark, sf))[0].withColumn("mi", F.round("mi", 8))


@query("cluster_guided_rank", f"""
WITH {OC}, {MI1}, lab AS (SELECT term, CAST(replace(term, 'Brand#', '') AS INT) % 6 - 1 AS c FROM mi),
tt AS (SELECT mi.term, c, row_number() OVER (PARTITION BY c ORDER BY round(mi, 9) DESC, mi.term) AS turn, CASE WHEN c >= 0 THEN count(*) OVER (PARTITION BY c) END AS size FROM mi JOIN lab USING (term))
SELECT term, row_number() OVER (ORDER BY c < 0, CASE WHEN c >= 0 THEN turn ELSE 0 END, size DESC, c, turn) - 1 AS position FROM tt""")
def cluster_guided_rank(spark, sf):
    from .warehouse_plans import symptom_clusters

    mi = sel.sparse_pair_cells(order_cells(spark, sf), order_labels(spark, sf))[0]
    out = sel.cluster_guided_rank(mi, symptom_clusters(spark, sf).withColumnRenamed("symptom", "term"))
    return out.withColumn("position", F.col("position").cast("long"))


NB = """sz AS (SELECT label AS class, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM ol GROUP BY 1),
nb AS (SELECT class, term, (count(oc.row_id) + 1) / (any_value(n) + 2) AS theta, ln(any_value(n) / any_value(t)) AS lp FROM sz CROSS JOIN (SELECT DISTINCT term FROM oc) JOIN ol ON label = class LEFT JOIN oc USING (row_id, term) GROUP BY 1, 2)"""


@query("nb_counts", f"WITH {OC}, {NB} SELECT class, term, round(theta, 8) AS theta, round(lp, 8) AS log_prior FROM nb")
def nb_counts(spark, sf):
    theta = sel.bernoulli_counts(order_cells(spark, sf), order_labels(spark, sf))
    return theta.select("class", "term", F.round("theta", 8).alias("theta"), F.round("log_prior", 8).alias("log_prior"))


def screened(spark, sf, top, questions):
    theta = sel.bernoulli_counts(order_cells(spark, sf), order_labels(spark, sf))
    base = bayes.knowledge_base(*sel.bayes_base(theta))
    return bayes.score_cases(sc.answer_sets(s.case_answers(spark, sf)), base, top, questions)


NBPOST = f"""{OC}, {NB}, {s.ANSWERS}, cl AS (SELECT DISTINCT class, lp FROM nb),
zz AS (SELECT case_id, class, any_value(lp) + sum(CASE WHEN present THEN ln(theta) ELSE ln(1 - theta) END) AS z FROM answers JOIN nb ON term = symptom GROUP BY 1, 2),
post AS (SELECT *, e / sum(e) OVER (PARTITION BY case_id) AS p FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY case_id)) AS e FROM zz))"""


@query("nb_posterior", f"WITH {NBPOST} SELECT case_id, class, round(p, 6) AS probability FROM post")
def nb_posterior(spark, sf):
    return screened(spark, sf, 5, 0).select("case_id", F.explode("ranked").alias("r")).select(
        "case_id", F.col("r.name").alias("class"), F.round("r.likelihood", 6).alias("probability"))


@query("nb_next_question", f"""
WITH {NBPOST}, g AS (SELECT case_id, term, -own + (s1 - m1 * log2(m1)) + (s0 - m0 * log2(m0)) AS gain FROM (
  SELECT case_id, term, sum(p * log2(p)) AS own, sum(p * theta) AS m1, sum(p * theta * log2(p * theta)) AS s1, sum(p * (1 - theta)) AS m0, sum(p * (1 - theta) * log2(p * (1 - theta))) AS s0
  FROM post JOIN nb USING (class) GROUP BY 1, 2))
SELECT case_id, round(max(gain), 5) AS gain FROM g WHERE NOT EXISTS (SELECT 1 FROM answers x WHERE x.case_id = g.case_id AND symptom = term) GROUP BY 1 HAVING max(gain) > 1e-6""")
def nb_next_question(spark, sf):
    asked = screened(spark, sf, 1, 1).where(F.size("questions") > 0)
    return asked.select("case_id", F.round(F.col("questions")[0]["gain"], 5).alias("gain"))


BUDGETS = (5, 10, 20, 30, 40, 60)


@query("compare_strategies")
def compare_strategies(spark, sf):
    from .warehouse_plans import symptom_clusters

    clusters = symptom_clusters(spark, sf).withColumnRenamed("symptom", "term")
    return sel.compare_strategies(order_cells(spark, sf), order_labels(spark, sf), clusters, BUDGETS)


LETTERS = "abcdefghijklmnopqrstuvwxy"


def letter_items(spark, sf):
    """25 items a document: how often each letter occurs in its whole text, in five levels; the label is its language."""
    text = F.lower(F.coalesce("text", F.lit("")))
    share = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    level = lambda c: F.least(F.floor(share(c) * 50 / F.greatest(F.length(text), F.lit(1))), F.lit(4)).cast("int")
    return table(spark, sf, "documents").select("doc_id", "lang", *[level(c).alias(f"item_{c}") for c in LETTERS])


@query("questionnaire_curve")
def questionnaire_curve(spark, sf):
    return sel.reduce_questionnaire(letter_items(spark, sf), [f"item_{c}" for c in LETTERS], "lang", "doc_id")


# --- association ------------------------------------------------------------------------------------
def _chi_sql(v):
    return f"""SELECT '{v}' AS variable, round(chi2, 5) AS chi2, (r - 1) * (k - 1) AS dof,
      round(CASE WHEN least(rc, kc) > 1 THEN sqrt(greatest(0, chi2 / t - (k - 1) * (r - 1) / (t - 1)) / (least(rc, kc) - 1)) ELSE 0 END, 6) AS effect
    FROM (SELECT *, r - (r - 1) ** 2 / (t - 1) AS rc, k - (k - 1) ** 2 / (t - 1) AS kc FROM (
      SELECT sum((n - e) ** 2 / e) AS chi2, any_value(t) AS t, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM (
        SELECT x, y, coalesce(n, 0) AS n, rx * cy / t AS e, t FROM (SELECT {v}::VARCHAR AS x, count(*)::DOUBLE AS rx FROM cohort WHERE outcome IS NOT NULL GROUP BY 1)
        CROSS JOIN (SELECT outcome AS y, count(*)::DOUBLE AS cy, sum(count(*)) OVER ()::DOUBLE AS t FROM cohort WHERE outcome IS NOT NULL GROUP BY 1)
        LEFT JOIN (SELECT {v}::VARCHAR AS x, outcome AS y, count(*) AS n FROM cohort WHERE outcome IS NOT NULL GROUP BY 1, 2) USING (x, y))))"""


@query("cramers_v", f"WITH {s.COHORT} " + " UNION ALL ".join(_chi_sql(v) for v in ("segment", "priority", "nation")))
def cramers_v(spark, sf):
    out = a.chi_square_tests(s.cohort(spark, sf), ["segment", "priority", "nation"], "outcome")
    return out.select("variable", F.round("chi2", 5).alias("chi2"), "dof", F.round("effect", 6).alias("effect"))


def _mw_sql(v):
    return f"""SELECT '{v}' AS variable, u, round(2 * u / (p * (t - p)) - 1, 6) AS effect, round((abs(u - p * (t - p) / 2) - 0.5) / sqrt(p * (t - p) / 12 * (t + 1 - ties / (t * (t - 1)))), 6) AS z FROM (
      SELECT sum(n1 * (b + (n + 1) / 2.0)) - sum(n1) * (sum(n1) + 1) / 2.0 AS u, sum(n1)::DOUBLE AS p, sum(n)::DOUBLE AS t, sum(n::DOUBLE ** 3 - n) AS ties FROM (
        SELECT n1, n, sum(n) OVER (ORDER BY x) - n AS b FROM (SELECT {v} AS x, count(*) FILTER (WHERE outcome = 1) AS n1, count(*) AS n FROM cohort WHERE outcome IS NOT NULL GROUP BY 1)))"""


@query("mann_whitney", f"WITH {s.COHORT} SELECT variable, u, effect FROM (" + " UNION ALL ".join(_mw_sql(v) for v in ("age", "o_totalprice", "c_acctbal")) + ")")
def mann_whitney(spark, sf):
    return a.mann_whitney(s.cohort(spark, sf), ["age", "o_totalprice", "c_acctbal"], "outcome").select("variable", "u", F.round("effect", 6).alias("effect"))


@query("univariate")
def univariate(spark, sf):
    return a.univariate(s.cohort(spark, sf), ["segment", "priority", "nation"], ["age", "o_totalprice", "c_acctbal"], "outcome")


@query("bh_qvalues", """
WITH t AS (SELECT c_nationkey, round(0.001 + 0.7 * (count(*) % 17) / 17.0, 6) AS p FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, c_nationkey) AS rk, count(*) OVER () AS m FROM t)
SELECT c_nationkey, p, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_qvalues(spark, sf):
    from ..functions.stats import benjamini_hochberg

    t = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select(
        "c_nationkey", F.round(0.001 + 0.7 * (F.col("n") % 17) / 17.0, 6).alias("p"))
    return benjamini_hochberg(t, "p", ["c_nationkey"], "q").withColumn("q", F.round("q", 6))


@query("adjusted_effects")
def adjusted_effects(spark, sf):
    x, groups = a.design(s.cohort(spark, sf), ["segment"], ["age", "c_acctbal"], "outcome")
    return a.adjusted_effects(x, groups)[0]


@query("likelihood_ratio")
def likelihood_ratio(spark, sf):
    x, groups = a.design(s.cohort(spark, sf), ["segment", "priority"], ["age", "c_acctbal", "o_totalprice"], "outcome")
    return a.adjusted_effects(x, groups)[1]


@query("stability_selection")
def stability_selection(spark, sf):
    x, groups = a.design(s.cohort(spark, sf), ["segment"], ["age", "c_acctbal", "o_totalprice", "record_id"], "outcome")
    return a.stability_selection(x, {k: v for k, v in groups.items() if k != "record_id"}, ["record_id"])


@query("permutation_importance")
def permutation_importance(spark, sf):
    return a.permutation_importance(s.cohort(spark, sf), ["segment"], ["age"], "outcome", "record_id", folds=2, repeats=1, max_iter=5)


EVIDENCE = """ev AS (SELECT c_nationkey AS variable, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 2000) AS poor, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS built FROM customer GROUP BY 1),
given AS (SELECT variable, round((n % 13) / 13.0 + 0.001, 6)::DOUBLE AS q_value, round((poor % 7) / 70.0 + 0.0001, 6)::DOUBLE AS lrt_p, round((built % 5) / 4.0, 6)::DOUBLE AS stability, round(((n + poor) % 9) / 9.0 - 0.3, 6)::DOUBLE AS perm_auc_drop,
  round(((n + poor) % 9) / 9.0 - 0.5, 6)::DOUBLE AS perm_ci_low FROM ev)"""


@query("evidence_table", f"""
WITH {EVIDENCE}, o AS (SELECT *, row_number() OVER (ORDER BY lrt_p, variable) AS rk, count(*) OVER () AS m FROM given),
t AS (SELECT *, least(1.0, min(lrt_p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS lrt_q FROM o),
v AS (SELECT *, (lrt_q < 0.05)::INT + (stability >= 0.6)::INT + (perm_ci_low > 0)::INT AS votes,
  (rank() OVER (ORDER BY q_value) + (count(*) OVER (PARTITION BY q_value) - 1) / 2.0 + rank() OVER (ORDER BY lrt_p) + (count(*) OVER (PARTITION BY lrt_p) - 1) / 2.0
  + rank() OVER (ORDER BY stability DESC) + (count(*) OVER (PARTITION BY stability) - 1) / 2.0 + rank() OVER (ORDER BY perm_auc_drop DESC) + (count(*) OVER (PARTITION BY perm_auc_drop) - 1) / 2.0) / 4 AS mean FROM t)
SELECT variable, q_value, stability, perm_auc_drop, round(lrt_q, 6) AS lrt_q, votes AS evidence_votes, CASE votes WHEN 3 THEN 'confirmed' WHEN 2 THEN 'supported' ELSE 'not supported' END AS evidence_tier,
  rank() OVER (ORDER BY round(mean, 9))::INT AS consensus_rank FROM v""")
def evidence_table(spark, sf):
    """Four lines of evidence per nation, each a table of its own, joined, voted on and ranked."""
    n, poor, built = F.count(F.lit(1)), F.count_if(F.col("c_acctbal") < 2000), F.count_if(F.col("c_mktsegment") == "BUILDING")
    ev = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("variable")).agg(n.alias("n"), poor.alias("poor"), built.alias("built"))
    uni = ev.select("variable", F.round(F.col("n") % 13 / 13.0 + 0.001, 6).alias("q_value"))
    lrt = ev.select("variable", F.round(F.col("poor") % 7 / 70.0 + 0.0001, 6).alias("lrt_p"))
    stable = ev.select("variable", F.round(F.col("built") % 5 / 4.0, 6).alias("stability"))
    part = (F.col("n") + F.col("poor")) % 9 / 9.0
    drop = ev.select("variable", F.round(part - 0.3, 6).alias("perm_auc_drop"), F.round(part - 0.5, 6).alias("perm_ci_low"))
    out = a.evidence_tiers(uni, lrt, stable, drop)
    return out.select("variable", "q_value", "stability", "perm_auc_drop", F.round("lrt_q", 6).alias("lrt_q"), "evidence_votes", "evidence_tier", "consensus_rank")


# --- scores --------------------------------------------------------------------------------------------
def scores(spark, sf):
    """A score per order: the outcome is known, the score mixes price and customer."""
    return s.cohort(spark, sf).where("outcome IS NOT NULL").select(
        "record_id", "outcome", "segment", "age", (F.floor(F.col("o_totalprice") / 1000) % 500 / 1000 + F.col("outcome") * 0.1 + (F.col("patient") % 7) / 50).alias("p0")).withColumn("p", F.round("p0", 3)).drop("p0")


SCORES = f"""{s.COHORT}, scores AS (SELECT record_id, outcome, segment, age, round(floor(o_totalprice / 1000) % 500 / 1000 + outcome * 0.1 + (patient % 7) / 50, 3) AS p FROM cohort WHERE outcome IS NOT NULL)"""
AUCSQL = """SELECT {k} (sum(n1 * (b + (n + 1) / 2.0)) - sum(n1) * (sum(n1) + 1) / 2.0) / (sum(n1) * (sum(n) - sum(n1))) AS auc FROM (
  SELECT {k} n1, n, sum(n) OVER ({pb} ORDER BY p) - n AS b FROM (SELECT {k} p, count(*) FILTER (WHERE outcome = 1) AS n1, count(*) AS n FROM {src} GROUP BY ALL)) {g}"""


@query("auc", f"WITH {SCORES} SELECT round(auc, 6) AS auc FROM ({AUCSQL.format(k='', pb='', src='scores', g='')})")
def auc(spark, sf):
    return a.auc(scores(spark, sf), "p", "outcome").select(F.round("auc", 6).alias("auc"))


THRESH = "thr AS (SELECT p AS thr FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS n, count(*) OVER () AS t FROM scores WHERE outcome = 1) WHERE n = floor((1 - 0.8::DOUBLE) * t))"
POINT = """round(count(*) FILTER (WHERE p >= thr AND outcome = 1)::DOUBLE / greatest(count(*) FILTER (WHERE outcome = 1), 1), 6) AS sensitivity,
  round(count(*) FILTER (WHERE p < thr AND outcome = 0)::DOUBLE / greatest(count(*) FILTER (WHERE outcome = 0), 1), 6) AS specificity"""


@query("operating_point", f"""
WITH {SCORES}, {THRESH} SELECT any_value(thr) AS threshold, {POINT},
  round(count(*) FILTER (WHERE p >= thr AND outcome = 1)::DOUBLE / greatest(count(*) FILTER (WHERE p >= thr), 1), 6) AS ppv,
  round(count(*) FILTER (WHERE p < thr AND outcome = 0)::DOUBLE / greatest(count(*) FILTER (WHERE p < thr), 1), 6) AS npv FROM scores, thr""")
def operating_point(spark, sf):
    rows = scores(spark, sf)
    thr = risk.threshold_for_sensitivity(rows, "p", "outcome")
    out = risk.operating_point(rows, "p", "outcome", thr)
    return out.select(F.lit(thr).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "ppv", "npv")])


@query("reliability_bins", f"""
WITH {SCORES}, e AS (SELECT list_distinct([{', '.join(f'quantile_cont(p, {i / 10})' for i in range(11))}]) AS e FROM scores),
b AS (SELECT outcome, p, greatest(len(list_filter(list_sort(e), lambda x: x < p)) - 1, 0) AS bin FROM scores, e)
SELECT bin::INT AS bin, round(avg(p), 4) AS mean_predicted, round(avg(outcome), 4) AS observed_rate, count(*) AS n FROM b GROUP BY 1""")
def reliability_bins(spark, sf):
    return risk.reliability(scores(spark, sf), "p", "outcome")


@query("subgroup_metrics", f"""
WITH {SCORES}, {THRESH}, long AS (SELECT 'segment' AS grouping_, segment AS level, p, outcome FROM scores UNION ALL SELECT 'age_band', CASE WHEN age < 45 THEN 'age<45' ELSE 'age>=45' END, p, outcome FROM scores),
au AS ({AUCSQL.format(k='grouping_, level,', pb='PARTITION BY grouping_, level', src='long', g='GROUP BY 1, 2')})
SELECT grouping_ AS "grouping", level, n, round(auc, 6) AS auc, sensitivity, specificity FROM (SELECT grouping_, level, count(*) AS n, {POINT} FROM long, thr GROUP BY 1, 2) JOIN au USING (grouping_, level)""")
def subgroup_metrics(spark, sf):
    rows = scores(spark, sf)
    thr = risk.threshold_for_sensitivity(rows, "p", "outcome")
    out = risk.subgroup_metrics(rows, {"segment": F.col("segment"), "age_band": risk.age_band(F.col("age"))}, "p", "outcome", thr)
    return out.select("grouping", "level", "n", *[F.round(c, 6).alias(c) for c in ("auc", "sensitivity", "specificity")])


@query("rank_metrics", """
WITH r AS (SELECT l_returnflag AS g, (l_partkey % 29 + 1) AS r FROM lineitem)
SELECT g, count(*) AS n, round(avg((r <= 1)::INT), 6) AS top1, round(avg((r <= 5)::INT), 6) AS top5, round(avg((r <= 10)::INT), 6) AS top10, round(avg(1.0 / r), 6) AS mrr,
  quantile_cont(r, 0.5)::DOUBLE AS median_rank FROM r GROUP BY 1""")
def rank_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_partkey") % 29 + 1).alias("r"))
    out = risk.rank_metrics(rows, "r", ["g"])
    return out.select("g", "n", *[F.round(c, 6).alias(c) for c in ("top1", "top5", "top10", "mrr")], "median_rank")


@query("bootstrap_auc")
def bootstrap_auc(spark, sf):
    return risk.bootstrap_auc_interval(scores(spark, sf), "p", "outcome", 200)


@query("calibration")
def calibration(spark, sf):
    slope, intercept = risk.calibration(scores(spark, sf), "p", "outcome")
    return s.cohort(spark, sf).agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"))


@query("risk_reasons")
def risk_reasons(spark, sf):
    cohort = s.cohort(spark, sf)
    known = cohort.where("outcome IS NOT NULL").withColumn("label", F.col("outcome").cast("double"))
    rows = risk.prepare(known, ["segment"], ["age", "c_acctbal"], ["label"])
    model = risk.logistic_candidate(["segment"], ["age", "c_acctbal"], rows.count()).fit(rows)
    reference = wh.reference_row(cohort, ["segment"], ["age", "c_acctbal"])
    return risk.score_with_reasons(model, cohort, reference, ["segment"], ["age", "c_acctbal"], "record_id", 0.5)


@query("constitution_model")
def constitution_model(spark, sf):
    return risk.constitution_model(table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag", 20)[0]


@query("risk_train")
def risk_train(spark, sf):
    train, hold = risk.holdout_split(s.cohort(spark, sf), "record_id")
    out = risk.train(train, hold, ["segment"], ["age", "c_acctbal"], "outcome", "record_id", folds=2, boosting_iter=5, reps=100)
    return out["operating_point"]
