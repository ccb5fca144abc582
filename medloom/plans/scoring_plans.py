"""Scoring queries: orders as cases, nations as conditions, brands as symptoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv
from ..operators import assessment, bayes
from ..operators import scoring as sc
from ..operators import warehouse as wh
from . import standins as s
from .base import query, sql_values, table
from .warehouse_plans import LLR

# Brands stand for canonical symptoms where rule tables name them.
SIGNS = sorted({x for *_, signs in fv.SUBDOSHAS for x in signs} | set(fv.AMA_SIGNS) | {x for x, _ in fv.SYMPTOM_TRIGGERS})
BRAND_SIGN = [(f"Brand#{i + 1}", SIGNS[(i * 5) % len(SIGNS)]) for i in range(25)]
BRAND_SQL = sql_values(BRAND_SIGN, "symptom, sign", "bs")


def named_answers(spark, sf):
    names = dims.dim(spark, BRAND_SIGN, "symptom string, sign string")
    return s.case_answers(spark, sf).join(F.broadcast(names), "symptom").select("case_id", F.col("sign").alias("symptom"), "present")


NAMED = f"named AS (SELECT case_id, sign AS symptom, present FROM answers JOIN {BRAND_SQL} USING (symptom))"


def checklist(spark, sf):
    codes = F.array(*[F.lit(c) for c, _ in fv.RED_FLAGS], F.lit("unknown_code"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.element_at(codes, (F.col("o_custkey") % 13 + 1).cast("int")).alias("code"), (F.col("o_orderkey") % 7 == 0).alias("yes"))


CHECK = f"""checklist AS (SELECT o_orderkey AS case_id, {[c for c, _ in fv.RED_FLAGS] + ['unknown_code']}[1 + o_custkey % 13] AS code, o_orderkey % 7 = 0 AS yes FROM orders)"""
TRIGGERS = sql_values(fv.SYMPTOM_TRIGGERS, "symptom, code", "tr")
CODES = ", ".join(f"'{c}'" for c, _ in fv.RED_FLAGS)


@query("triage_rules", f"""
WITH {s.ANSWERS}, {NAMED}, {CHECK},
em AS (SELECT case_id, code FROM checklist WHERE yes AND code IN ({CODES})),
ur AS (SELECT case_id, code FROM named JOIN {TRIGGERS} USING (symptom) WHERE present AND (case_id, code) NOT IN (SELECT (case_id, code) FROM em))
SELECT o_orderkey AS case_id, CASE WHEN e > 0 THEN 'emergency' WHEN u > 0 THEN 'urgent' ELSE 'routine' END AS level, e + u AS flags
FROM (SELECT o_orderkey, (SELECT count(*) FROM em WHERE em.case_id = o_orderkey) AS e, (SELECT count(*) FROM ur WHERE ur.case_id = o_orderkey) AS u FROM orders)""")
def triage_rules(spark, sf):
    return sc.triage(s.cases(spark, sf), checklist(spark, sf), named_answers(spark, sf)).select(
        "case_id", "level", F.size("flags").cast("long").alias("flags"))


SOFT = """CASE WHEN sh.l - sh.m < 0.1 THEN 'pair' ELSE 'single' END"""
COEF = [(q, o, round(((i * 7) % 11) / 5 - 1, 2), round(((i * 5) % 13) / 6 - 1, 2), round(((i * 3) % 7) / 3 - 1, 2))
        for i, (q, o) in enumerate([("item1", "A"), ("item1", "N"), ("item1", "R"), ("item2", "F"), ("item2", "O"), ("item3", "1"), ("item3", "2"), ("item3", "3")])]
INTERCEPT = {"vata": 0.1, "pitta": -0.2, "kapha": 0.05}


def shares_sql(z, extra=""):
    """Softmax of z columns zv, zp, zk in relation ``z`` plus the dominant code."""
    return f"""sh AS (SELECT *, exp(zv - g) / t AS vata, exp(zp - g) / t AS pitta, exp(zk - g) / t AS kapha FROM (
  SELECT *, exp(zv - g) + exp(zp - g) + exp(zk - g) AS t FROM (SELECT *, greatest(zv, zp, zk) AS g FROM {z}))),
dm AS (SELECT *, greatest(vata, pitta, kapha) AS hi, least(vata, pitta, kapha) AS lo FROM sh),
sd AS (SELECT *, CASE WHEN hi - (vata + pitta + kapha - hi - lo) < 0.10 THEN
    CASE lo WHEN kapha THEN 'vata-pitta' WHEN pitta THEN 'vata-kapha' ELSE 'pitta-kapha' END
    ELSE CASE hi WHEN vata THEN 'vata' WHEN pitta THEN 'pitta' ELSE 'kapha' END END AS dominant FROM dm)"""


@query("constitution_softmax", f"""
WITH a AS (SELECT l_orderkey AS case_id, 'item1' AS question, l_returnflag AS option_ FROM lineitem UNION ALL SELECT l_orderkey, 'item2', l_linestatus FROM lineitem
  UNION ALL SELECT l_orderkey, 'item3', l_linenumber::VARCHAR FROM lineitem),
z AS (SELECT case_id, count(*) AS answered, 0.1 + sum(v) AS zv, -0.2 + sum(p) AS zp, 0.05 + sum(k) AS zk FROM a JOIN {sql_values(COEF, 'question, option_, v, p, k', 'co')} USING (question, option_) GROUP BY 1),
{shares_sql('z')} SELECT case_id, answered, round(vata, 6) AS vata, round(pitta, 6) AS pitta, round(kapha, 6) AS kapha, dominant FROM sd""")
def constitution_softmax(spark, sf):
    coef = dims.dim(spark, COEF, "question string, option string, vata double, pitta double, kapha double")
    answers = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.explode(F.array(
        F.struct(F.lit("item1").alias("question"), F.col("l_returnflag").alias("option")), F.struct(F.lit("item2").alias("question"), F.col("l_linestatus").alias("option")),
        F.struct(F.lit("item3").alias("question"), F.col("l_linenumber").cast("string").alias("option")))).alias("a")).select("case_id", "a.*")
    return sc.constitution(answers, coef, INTERCEPT).select("case_id", "answered", *[F.round(d, 6).alias(d) for d in fv.DOSHAS], "dominant")


_EV = [(src, item) for src, item in dict.fromkeys((a, b) for a, b, *_ in fv.EVIDENCE_WEIGHTS)]


def findings(spark, sf):
    pairs = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("item")) for a, b in _EV], F.struct(F.lit("pariksha.jihva").alias("source"), F.lit("normal").alias("item")))
    picks = F.array((F.col("o_custkey") % (len(_EV) + 1) + 1).cast("int"), (F.col("o_orderkey") % (len(_EV) + 1) + 1).cast("int"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.array_distinct(picks)).alias("i"))
    return rows.select("case_id", F.element_at(pairs, F.col("i")).alias("f")).select("case_id", "f.source", "f.item")


_EVSQL = sql_values([(i, a, b) for i, (a, b) in enumerate(_EV)] + [(len(_EV), "pariksha.jihva", "normal")], "i, source, item", "ev")
WEIGHTS = sql_values(fv.EVIDENCE_WEIGHTS, "source, item, dosha, w", "ew")
FIND = f"""findings AS (SELECT DISTINCT case_id, source, item FROM (SELECT o_orderkey AS case_id, unnest([o_custkey % {len(_EV) + 1}, o_orderkey % {len(_EV) + 1}]) AS i FROM orders) JOIN {_EVSQL} USING (i)),
exam AS (SELECT case_id, count(DISTINCT source || item) AS items, coalesce(sum(w) FILTER (WHERE dosha = 'vata'), 0) AS ev, coalesce(sum(w) FILTER (WHERE dosha = 'pitta'), 0) AS ep,
   coalesce(sum(w) FILTER (WHERE dosha = 'kapha'), 0) AS ek FROM findings JOIN {WEIGHTS} USING (source, item) GROUP BY 1)"""


@query("examination_evidence", f"WITH {FIND} SELECT case_id, items, round(ev, 6) AS vata, round(ep, 6) AS pitta, round(ek, 6) AS kapha FROM exam")
def examination_evidence(spark, sf):
    return sc.examination_evidence(findings(spark, sf)).select("case_id", "items", *[F.round(d, 6).alias(d) for d in fv.DOSHAS])


KB = f"{s.CONDITIONS}, {s.BRIDGE}, {LLR}, {s.ANSWERS}"
IMB = f"""used AS (SELECT case_id, count(DISTINCT symptom) AS used, sum(llr) FILTER (WHERE dosha = 'vata') AS sv, sum(llr) FILTER (WHERE dosha = 'pitta') AS sp, sum(llr) FILTER (WHERE dosha = 'kapha') AS sk
  FROM answers JOIN llr USING (symptom) WHERE present GROUP BY 1),
bs AS (SELECT max(base) FILTER (WHERE d = 'vata') AS bv, max(base) FILTER (WHERE d = 'pitta') AS bp, max(base) FILTER (WHERE d = 'kapha') AS bk FROM base),
zi AS (SELECT case_id, coalesce(used, 0) AS used, ln(bv) + (coalesce(sv, 0) + coalesce(ev, 0)) / h AS zv, ln(bp) + (coalesce(sp, 0) + coalesce(ep, 0)) / h AS zp, ln(bk) + (coalesce(sk, 0) + coalesce(ek, 0)) / h AS zk
  FROM (SELECT *, greatest(1.0, sqrt(coalesce(used, 0) + coalesce(items, 0))) AS h FROM used FULL JOIN exam USING (case_id)) CROSS JOIN bs), {shares_sql('zi')}"""


def knowledge(spark, sf):
    return s.conditions(spark, sf), s.bridge(spark, sf)


@query("imbalance_softmax", f"""
WITH {KB}, {FIND}, {IMB} SELECT case_id, used, round(vata, 6) AS vata, round(pitta, 6) AS pitta, round(kapha, 6) AS kapha, dominant FROM sd""")
def imbalance_softmax(spark, sf):
    conditions, bridge = knowledge(spark, sf)
    out = sc.imbalance(s.case_answers(spark, sf), wh.dosha_llr(bridge, conditions), conditions, sc.examination_evidence(findings(spark, sf)))
    return out.select("case_id", "used", *[F.round(d, 6).alias(d) for d in fv.DOSHAS], "dominant")


AMA = ", ".join(f"'{a}'" for a in fv.AMA_SIGNS)


@query("ama_level", f"""
WITH {s.ANSWERS}, {NAMED}, {FIND},
sg AS (SELECT DISTINCT case_id, symptom AS sign FROM named WHERE present AND symptom IN ({AMA}) UNION ALL SELECT case_id, 'coated tongue (examined)' FROM findings WHERE source = 'pariksha.jihva' AND item = 'coated_white')
SELECT o_orderkey AS case_id, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'moderate' ELSE 'low' END AS level, n AS signs
FROM (SELECT o_orderkey, count(sign) AS n FROM orders LEFT JOIN sg ON case_id = o_orderkey GROUP BY 1)""")
def ama_level(spark, sf):
    tongue = findings(spark, sf).where("source = 'pariksha.jihva'")
    return sc.ama_level(s.cases(spark, sf), named_answers(spark, sf), tongue).select("case_id", "level", F.size("signs").cast("long").alias("signs"))


def season_case(day):
    from .longitudinal_plans import season_sql

    return season_sql(day)


def weight_sql(d):
    states = " ".join(f"WHEN '{n}' THEN {fv.STATE_WEIGHTS[fv.DOSHA_CYCLE[d].get(n, 'neutral')]}" for n, *_ in fv.SEASONS)
    places = ", ".join(f"'{h}'" for h, ds in fv.HABITAT_DOSHAS.items() if d in ds)
    return f"(CASE {season_case('on_date')} {states} END * CASE WHEN habitat IN ({places}) THEN 1.05 ELSE 1.0 END)::DOUBLE"


@query("season_weights", f"""
WITH {s.CASES} SELECT case_id, {', '.join(f'round({weight_sql(d)}, 6) AS {d}_season' for d in fv.DOSHAS)} FROM cases""")
def season_weights(spark, sf):
    cols = sc.season_weights(F.col("on_date"), F.col("habitat"))
    out = s.cases(spark, sf).select("case_id", *cols)
    return out.select("case_id", *[F.round(f"{d}_season", 6).alias(f"{d}_season") for d in fv.DOSHAS])


TERMS = """terms AS (SELECT symptom, round(0.02 + 0.08 * df / max(df) OVER (), 4) AS background FROM (SELECT symptom, count(*) AS df FROM bridge GROUP BY 1))"""


def terms(bridge):
    df = bridge.groupBy("symptom").agg(F.count(F.lit(1)).alias("df"))
    top = df.agg(F.max("df").alias("m"))
    return df.join(F.broadcast(top)).select("symptom", F.round(0.02 + 0.08 * F.col("df") / F.col("m"), 4).alias("background"))


FEED = """fcases AS (SELECT o_orderkey AS case_id, o_custkey % 25 AS condition_id FROM orders WHERE o_orderstatus = 'F')"""


def feedback(spark, sf):
    confirmed = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 25).cast("int").alias("condition_id"))
    return sc.feedback_counts(confirmed, s.case_answers(spark, sf))


@query("feedback_counts", f"""
WITH {s.ANSWERS}, {FEED} SELECT condition_id, symptom, sum(present::INT)::BIGINT AS present, count(*) AS asked FROM answers JOIN fcases USING (case_id) GROUP BY 1, 2""")
def feedback_counts(spark, sf):
    return feedback(spark, sf)[1].withColumn("condition_id", F.col("condition_id").cast("long"))


@query("theta_table", f"""
WITH {KB}, {TERMS}, {FEED},
fb AS (SELECT condition_id, symptom, sum(present::INT) AS present, count(*) AS asked FROM answers JOIN fcases USING (case_id) GROUP BY 1, 2),
st AS (SELECT t.symptom, n_nationkey AS condition_id, CASE WHEN b.symptom IS NOT NULL THEN 0.8 ELSE background END AS start, b.symptom IS NOT NULL AS listed
  FROM terms t CROSS JOIN nation LEFT JOIN bridge b ON b.symptom = t.symptom AND b.condition_id = n_nationkey)
SELECT condition_id::INT AS condition_id, symptom, round(least(greatest(CASE WHEN asked IS NOT NULL THEN (10 * start + present) / (10 + asked) ELSE start END, 1e-4), 1 - 1e-4), 6) AS theta
FROM st LEFT JOIN fb USING (condition_id, symptom) WHERE listed OR asked IS NOT NULL""")
def theta_table(spark, sf):
    _, bridge = knowledge(spark, sf)
    return sc.theta_cells(bridge, terms(bridge), feedback(spark, sf)[1]).withColumn("theta", F.round("theta", 6))


POST = f"""{KB}, {TERMS}, {s.CASES}, exam AS (SELECT NULL::BIGINT AS case_id, 0 AS items, 0.0 AS ev, 0.0 AS ep, 0.0 AS ek WHERE false), {IMB},
kb AS (SELECT condition_id, lower(name) AS name, ln(1.0 / count(*) OVER ()) + ln(prior_weight) AS lp, age_low, age_high, female_weight, male_weight FROM conditions WHERE NOT profile_conflict),
mix AS (SELECT condition_id, coalesce(sum(1.0 / n) FILTER (WHERE dosha = 'vata'), 0) AS mv, coalesce(sum(1.0 / n) FILTER (WHERE dosha = 'pitta'), 0) AS mp, coalesce(sum(1.0 / n) FILTER (WHERE dosha = 'kapha'), 0) AS mk
  FROM (SELECT *, count(*) OVER (PARTITION BY condition_id) AS n FROM components) GROUP BY 1),
sym AS (SELECT case_id, kb.condition_id, sum(CASE WHEN present THEN ln(th) ELSE ln(1 - th) END) AS ss FROM (
   SELECT a.case_id, a.present, kb.condition_id, CASE WHEN b.symptom IS NOT NULL THEN 0.8 ELSE background END AS th
   FROM answers a JOIN terms USING (symptom) CROSS JOIN kb LEFT JOIN bridge b ON b.condition_id = kb.condition_id AND b.symptom = a.symptom) x JOIN kb USING (condition_id) GROUP BY 1, 2),
zz AS (SELECT c.case_id, kb.condition_id, name, lp + coalesce(ss, 0)
   + CASE WHEN age IS NULL THEN 0 ELSE ln(greatest(0.15, 1 - greatest(age_low - age, age - age_high, 0) / 20.0)) END
   + CASE sex WHEN 'female' THEN ln(female_weight) WHEN 'male' THEN ln(male_weight) ELSE 0 END
   + CASE WHEN sd.case_id IS NOT NULL THEN (sd.vata - 1.0 / 3) * mv + (sd.pitta - 1.0 / 3) * mp + (sd.kapha - 1.0 / 3) * mk ELSE 0 END
   + ln({weight_sql('vata')} * mv + {weight_sql('pitta')} * mp + {weight_sql('kapha')} * mk) AS z
   FROM (SELECT * FROM cases WHERE case_id IN (SELECT case_id FROM answers)) c CROSS JOIN kb JOIN mix USING (condition_id)
   LEFT JOIN sym ON sym.case_id = c.case_id AND sym.condition_id = kb.condition_id LEFT JOIN sd ON sd.case_id = c.case_id),
post AS (SELECT *, e / sum(e) OVER (PARTITION BY case_id) AS p FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY case_id)) AS e FROM zz))"""


def scored(spark, sf, top, questions, chunk=bayes.CHUNK):
    conditions, bridge = knowledge(spark, sf)
    vocab = terms(bridge)
    answers = s.case_answers(spark, sf)
    base = bayes.knowledge_base(sc.model_conditions(conditions), sc.theta_cells(bridge, vocab), vocab, chunk)
    state = sc.imbalance(answers, wh.dosha_llr(bridge, conditions), conditions)
    cases = s.cases(spark, sf).join(sc.answer_sets(answers), "case_id").join(
        state.select("case_id", F.array(*fv.DOSHAS).alias("vikriti")), "case_id", "left")
    cases = cases.withColumn("age", F.col("age").cast("double")).withColumn(
        "season", F.array(*sc.season_weights(F.col("on_date"), F.col("habitat"))))
    return bayes.score_cases(cases, base, top, questions)


TOPK = f"""WITH {POST},
named2 AS (SELECT *, row_number() OVER (PARTITION BY case_id, name ORDER BY round(z, 9) DESC, condition_id) AS nn FROM post)
SELECT case_id, position, condition_id, round(p, 6) AS likelihood FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(z, 9) DESC, condition_id) - 1 AS position FROM named2 WHERE nn = 1) WHERE position < 10"""


def _topk(df):
    return df.select("case_id", F.posexplode("ranked").alias("position", "r")).select(
        "case_id", F.col("position").cast("long").alias("position"), "r.condition_id", F.round("r.likelihood", 6).alias("likelihood"))


@query("differential_topk", TOPK)
def differential_topk(spark, sf):
    return _topk(scored(spark, sf, 10, 0))


@query("differential_blocks", TOPK)
def differential_blocks(spark, sf):
    """The same ranking with the lists of untouched conditions read in chunks of eight."""
    return _topk(scored(spark, sf, 10, 0, chunk=8))


@query("differential_factors", f"""WITH {POST}
SELECT case_id, round(lp, 3) AS prior, round(CASE WHEN age IS NULL THEN 0 ELSE ln(greatest(0.15, 1 - greatest(age_low - age, age - age_high, 0) / 20.0)) END, 3) + 0.0 AS age,
  round(CASE sex WHEN 'female' THEN ln(female_weight) WHEN 'male' THEN ln(male_weight) ELSE 0 END, 3) + 0.0 AS sex
FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(z, 9) DESC, condition_id) AS n FROM post) JOIN kb USING (condition_id) JOIN cases USING (case_id) WHERE n = 1""")
def differential_factors(spark, sf):
    first = scored(spark, sf, 1, 0).select("case_id", F.col("ranked")[0]["factors"].alias("f"))
    return first.select("case_id", *[(F.col(f"f.{k}") + F.lit(0.0)).alias(k) for k in ("prior", "age", "sex")])


GAIN = """gain AS (SELECT case_id, symptom, -max(own) + (s1 - m1 * log2(m1)) + (s0 - m0 * log2(m0)) AS gain FROM (
  SELECT q.case_id, t.symptom, sum(p * log2(p)) AS own, sum(p * th) AS m1, sum(p * th * log2(p * th)) AS s1, sum(p * (1 - th)) AS m0, sum(p * (1 - th) * log2(p * (1 - th))) AS s0
  FROM post q CROSS JOIN terms t JOIN th2 ON th2.condition_id = q.condition_id AND th2.symptom = t.symptom GROUP BY 1, 2) GROUP BY 1, 2, s1, m1, s0, m0)"""


@query("info_gain", f"""
WITH {POST}, th2 AS (SELECT kb.condition_id, t.symptom, CASE WHEN b.symptom IS NOT NULL THEN 0.8 ELSE background END AS th
  FROM kb CROSS JOIN terms t LEFT JOIN bridge b ON b.condition_id = kb.condition_id AND b.symptom = t.symptom), {GAIN}
SELECT case_id, position, symptom, round(gain, 6) AS gain FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(gain, 9) DESC, symptom) - 1 AS position FROM gain g
  WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.case_id = g.case_id AND a.symptom = g.symptom)) WHERE position < 3 AND gain > 1e-6""")
def info_gain(spark, sf):
    out = scored(spark, sf, 1, 3).select("case_id", F.posexplode("questions").alias("position", "q"))
    return out.select("case_id", F.col("position").cast("long").alias("position"), "q.symptom", F.round("q.gain", 6).alias("gain"))


SIGN_ROWS = sql_values(
    [("subdosha", n, "sign", x) for n, *_, signs in fv.SUBDOSHAS for x in signs]
    + [("tissue", n, "kshaya", x) for n, _, lo, _ in fv.DHATUS for x in lo] + [("tissue", n, "vriddhi", x) for n, _, _, hi in fv.DHATUS for x in hi]
    + [("channel", n, "sign", x) for n, _, signs in fv.SROTAS for x in signs], "kind, entity, side, symptom", "sg")


@query("rule_overlap", f"""
WITH {s.ANSWERS}, {NAMED} SELECT case_id, kind, entity, side, count(*) AS score, array_to_string(list_sort(list(DISTINCT symptom)), '|') AS matched
FROM named JOIN {SIGN_ROWS} USING (symptom) WHERE present GROUP BY 1, 2, 3, 4""")
def rule_overlap(spark, sf):
    return sc.derived_signs(named_answers(spark, sf)).withColumn("matched", F.array_join("matched", "|"))


def _tissue_sql(name, lo, hi):
    low = ", ".join(f"'{x}'" for x in lo)
    high = ", ".join(f"'{x}'" for x in hi) or "''"
    b_lo = " OR bmi < 18.5" if name in ("mamsa", "meda") else ""
    b_hi = " OR bmi >= 25" if name == "meda" else ""
    l, h = f"(coalesce(bool_or(present AND symptom IN ({low})), false){b_lo})", f"(coalesce(bool_or(present AND symptom IN ({high})), false){b_hi})"
    return f"CASE WHEN {l} AND {h} THEN 'mixed' WHEN {l} THEN 'kshaya' WHEN {h} THEN 'vriddhi' ELSE 'normal' END AS {name}"


@query("tissue_states", f"""
WITH {s.ANSWERS}, {NAMED}, c AS (SELECT o_orderkey AS case_id, (15 + o_custkey % 17)::DOUBLE AS bmi FROM orders)
SELECT c.case_id, {', '.join(_tissue_sql(n, lo, hi) for n, _, lo, hi in fv.DHATUS)} FROM c LEFT JOIN named USING (case_id) GROUP BY c.case_id, bmi""")
def tissue_states(spark, sf):
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (15 + F.col("o_custkey") % 17).cast("double").alias("bmi"))
    return sc.tissue_states(cases, named_answers(spark, sf), "bmi")


@query("life_stage_clock", """
SELECT event_id, CASE WHEN age < 30 THEN 'bala' WHEN age < 60 THEN 'madhya' WHEN age < 200 THEN 'jirna' END AS stage,
  CASE WHEN h >= 6 AND h < 10 THEN 'kapha' WHEN h >= 10 AND h < 14 THEN 'pitta' WHEN h >= 14 AND h < 18 THEN 'vata' WHEN h >= 18 AND h < 22 THEN 'kapha'
       WHEN h >= 22 OR h < 2 THEN 'pitta' ELSE 'vata' END AS clock
FROM (SELECT event_id, user_id % 90 + value / 10 AS age, hour(ts) AS h FROM events)""")
def life_stage_clock(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", sc.life_stage(F.col("user_id") % 90 + F.col("value") / 10)["stage"].alias("stage"), sc.clock_dosha(F.hour("ts")).alias("clock"))


@query("guidance", f"""
WITH {s.CASES} SELECT case_id, 2 AS season_tips, CASE case_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 0 END AS balance_tips, {season_case('on_date')} AS season FROM cases""")
def guidance(spark, sf):
    from ..operators.longitudinal import season_of

    dominant = F.when(F.col("case_id") % 4 == 0, "kapha").when(F.col("case_id") % 4 == 1, "vata-pitta").when(F.col("case_id") % 4 == 2, "tridosha")
    season = season_of(F.col("on_date"))
    tips = s.cases(spark, sf).select("case_id", season.alias("season"), *sc.guidance(season, dominant))
    return tips.select("case_id", F.size("season_tips").alias("season_tips"), F.size("balance_tips").alias("balance_tips"), "season")


@query("idf_match", f"""
WITH {s.CONDITIONS}, {s.BRIDGE}, {s.ANSWERS},
prof AS (SELECT b.*, name, count(*) OVER (PARTITION BY condition_id) AS len FROM bridge b JOIN conditions USING (condition_id) WHERE NOT profile_conflict),
idf AS (SELECT symptom, ln((1 + (SELECT count(DISTINCT condition_id) FROM prof))::DOUBLE / (1 + count(*))) + 1 AS idf FROM prof GROUP BY 1),
sc AS (SELECT case_id, condition_id, name, sum(CASE WHEN present THEN idf ELSE -0.5 * idf END / sqrt(len)) AS score FROM answers JOIN prof USING (symptom) JOIN idf USING (symptom)
  WHERE case_id IN (SELECT case_id FROM answers WHERE present) GROUP BY 1, 2, 3),
d AS (SELECT *, row_number() OVER (PARTITION BY case_id, lower(name) ORDER BY round(score, 9) DESC, condition_id) AS nn FROM sc WHERE score > 1e-12)
SELECT case_id, position, condition_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, condition_id) - 1 AS position FROM d WHERE nn = 1) WHERE position < 5""")
def idf_match(spark, sf):
    conditions, bridge = knowledge(spark, sf)
    cases = sc.answer_sets(s.case_answers(spark, sf))
    out = bayes.match_by_idf(cases, conditions.where("NOT profile_conflict"), bridge).select("case_id", F.posexplode("ranked").alias("position", "r"))
    return out.select("case_id", F.col("position").cast("long").alias("position"), "r.condition_id", F.round("r.score", 6).alias("score"))


@query("assess_full")
def assess_full(spark, sf):
    conditions, bridge = knowledge(spark, sf)
    cases = s.cases(spark, sf).withColumn("bmi", (15 + F.col("case_id") % 17).cast("double"))
    out = assessment.assess(cases, s.case_answers(spark, sf), checklist(spark, sf), findings(spark, sf), conditions, bridge, terms(bridge),
                            wh.dosha_llr(bridge, conditions))
    return out.select("case_id", "triage.level", "stopped", "vikriti.dominant", F.to_json("differential").alias("differential"), F.to_json("questions").alias("questions"), "season")
