"""Ledger, daily-log, privacy and learning-loop queries on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import histories as hi
from ..operators import longitudinal as lo
from ..operators import privacy as pv
from . import standins as s
from .base import query, sql_values, table

def today():
    return F.lit(s.TODAY).cast("date")


TODAY_SQL = f"DATE '{s.TODAY}'"


@query("latest_consent", f"WITH {s.CONSENTS} SELECT user_id, purpose, arg_max(granted, id) AS granted FROM consents GROUP BY 1, 2")
def latest_consent(spark, sf):
    return lo.consents_in_force(s.consents(spark, sf))


@query("latest_encounter", f"""
WITH {s.ENCOUNTERS} SELECT patient_id, id, status, triage_level FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) AS n FROM encounters WHERE NOT stopped) WHERE n = 1""")
def latest_encounter(spark, sf):
    return lo.latest_usable_encounter(s.encounters(spark, sf)).select("patient_id", "id", "status", "triage_level")


def daily_scored(spark, sf):
    """Routine map of each write: item i is done when bit i of the payload is set."""
    d = s.daily_entries(spark, sf)
    items = F.create_map(*[x for i, (item, _) in enumerate(fv.ROUTINE_POINTS) for x in (
        F.lit(item), (F.floor(F.col("k") / (2**i)) % 2 == 1) if i < 7 else (F.col("value") > 50))])
    return d.withColumn("score", lo.routine_score(items))


SCORE = " + ".join(
    [f"CASE WHEN (k // {2**i}) % 2 = 1 THEN {p} ELSE 0 END" for i, (_, p) in enumerate(fv.ROUTINE_POINTS) if i < 7]
    + ["CASE WHEN value > 50 THEN 10 ELSE 0 END"])
LOGS = f"""{s.DAILY},
logs AS (SELECT user_id, day, id, k, value, score FROM (SELECT *, {SCORE} AS score, row_number() OVER (PARTITION BY user_id, day ORDER BY written_at DESC, id DESC) AS n
  FROM daily WHERE day <= CAST(written_at AS DATE) AND day >= CAST(written_at AS DATE) - 30) WHERE n = 1)"""


def daily_logs(spark, sf):
    return lo.upsert_daily(daily_scored(spark, sf))


@query("routine_score", f"WITH {s.DAILY} SELECT id, {SCORE} AS score FROM daily")
def routine_score(spark, sf):
    return daily_scored(spark, sf).select("id", "score")


@query("upsert_last", f"WITH {LOGS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, id, score FROM logs")
def upsert_last(spark, sf):
    return daily_logs(spark, sf).select("user_id", F.col("day").cast("string").alias("day"), "id", "score")


@query("week_window", f"""
WITH {LOGS} SELECT user_id, count(*) AS days, round(avg(score), 6) AS mean_score FROM logs WHERE day > {TODAY_SQL} - 7 GROUP BY 1""")
def week_window(spark, sf):
    return lo.week_window(daily_logs(spark, sf), today()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.avg("score"), 6).alias("mean_score"))


STREAK = f"""streak AS (SELECT user_id, count(*) FILTER (WHERE {TODAY_SQL} - day - n + 1 = 0) AS streak FROM (
  SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM logs WHERE day <= {TODAY_SQL}) GROUP BY 1)"""


@query("streak", f"WITH {LOGS}, {STREAK} SELECT user_id, streak FROM streak")
def streak(spark, sf):
    return lo.streaks(daily_logs(spark, sf), today())


LABELS = f"""{s.ENCOUNTERS}, {s.REVIEWS},
conf AS (SELECT encounter_id, condition_id AS c FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY created_at DESC, id DESC) AS n
   FROM reviews WHERE decision IN ('confirmed', 'revised')) WHERE n = 1),
labelled AS (SELECT e.*, CASE WHEN encounter_id IS NOT NULL THEN c ELSE top_condition END AS label FROM encounters e LEFT JOIN conf ON encounter_id = id)"""


@query("timeline_recurring", f"""
WITH {LABELS}, per AS (SELECT patient_id, label, ritu, count(*) AS n FROM labelled WHERE label IS NOT NULL GROUP BY 1, 2, 3)
SELECT patient_id, label, sum(n)::BIGINT AS episodes, max(n) >= 2 AS seasonal FROM per GROUP BY 1, 2 HAVING sum(n) >= 2""")
def timeline_recurring(spark, sf):
    return lo.recurring(lo.encounter_labels(s.encounters(spark, sf), s.reviews(spark, sf)))


@query("trend_first_last", f"""
WITH {s.ENCOUNTERS} SELECT patient_id, round(arg_max(vata, (created_at, id)) - arg_min(vata, (created_at, id)), 3) AS vata_trend
FROM encounters WHERE NOT stopped GROUP BY 1 HAVING count(*) >= 2""")
def trend_first_last(spark, sf):
    return lo.first_last_trend(s.encounters(spark, sf).where("NOT stopped"), "patient_id", ["created_at", "id"], ["vata"])


@query("trend_series", f"""
WITH {s.ENCOUNTERS}, {LOGS}
SELECT patient_id AS user_id, 'checkup' AS series, strftime(created_at, '%Y-%m-%d') AS at, vata AS value FROM encounters WHERE NOT stopped
UNION ALL SELECT user_id, 'routine', strftime(day, '%Y-%m-%d'), score::DOUBLE FROM logs""")
def trend_series(spark, sf):
    return lo.trend_series(s.encounters(spark, sf), daily_logs(spark, sf)).withColumn("at", F.col("at").cast("string"))


@query("last_n_history", """
SELECT event_id, user_id, event_type, position FROM (
  SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS position FROM events) WHERE position <= 24""")
def last_n_history(spark, sf):
    out = lo.last_n(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("event_id", "user_id", "event_type", F.col("position").cast("long").alias("position"))


SEASONS = sql_values([(n, m * 100 + d) for n, m, d, _ in fv.SEASONS], "season, md", "sea")


def season_sql(day):
    cases = " ".join(f"WHEN month({day}) * 100 + day({day}) >= {m * 100 + d} THEN '{n}'" for n, m, d, _ in reversed(fv.SEASONS))
    return f"CASE {cases} ELSE 'hemanta' END"


@query("season_forecast", f"""
WITH days AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders),
st AS (SELECT o_orderkey, season, make_date(year(day) + y, md // 100, md % 100) AS starts, day FROM days CROSS JOIN (VALUES (0), (1)) AS yy(y) CROSS JOIN {SEASONS})
SELECT o_orderkey, season, days_away::INT AS days_away FROM (
  SELECT o_orderkey, season, starts - day AS days_away, row_number() OVER (PARTITION BY o_orderkey ORDER BY starts) AS n FROM st WHERE starts > day) WHERE n <= 2""")
def season_forecast(spark, sf):
    days = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return lo.upcoming_seasons(days, "day").select("o_orderkey", "season", "days_away")


@query("season_of_day", f"SELECT {season_sql('l_shipdate')} AS season, count(*) AS n FROM lineitem GROUP BY 1")
def season_of_day(spark, sf):
    return table(spark, sf, "lineitem").groupBy(lo.season_of(F.to_date("l_shipdate")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


# --- meals: foods numbered by the payload ---------------------------------------------------------
FOOD_NAMES = [f for f, *_ in fv.FOODS]
PLATE = [("breakfast", "k % 25"), ("breakfast", "(k * 7 + 3) % 25"), ("lunch", "(k * 11 + 5) % 25"), ("dinner", "(k * 3 + 1) % 25"), ("dinner", "(k * 5 + 7) % 25")]


def meals(logs):
    names = F.array(*[F.lit(f) for f in FOOD_NAMES])
    plate = F.array(*[F.struct(F.lit(m).alias("meal"), F.element_at(names, F.expr(f"cast({e} as int)") + 1).alias("food")) for m, e in PLATE])
    return logs.select("user_id", "day", F.explode(plate).alias("p")).select("user_id", "day", "p.meal", "p.food")


FOOD_SQL = "[" + ", ".join(f"'{f}'" for f in FOOD_NAMES) + "]"
PLATES = "plates AS (" + " UNION ALL ".join(f"SELECT user_id, day, '{m}' AS meal, {FOOD_SQL}[({e}) + 1] AS food FROM logs" for m, e in PLATE) + ")"
TAGS = sql_values([(f, t) for f, _, tags in fv.FOODS for t in tags], "food, tag", "tg")
TASTES = sql_values([(f, t) for f, tastes, _ in fv.FOODS for t in tastes], "food, taste", "ts")
RULES = sql_values([(i, t, len(tags), m) for i, (tags, m, _) in enumerate(fv.MEAL_RULES) for t in tags], "rule_id, tag, needed, only_meal", "ru")


@query("meal_rules", f"""
WITH {LOGS}, {PLATES}, on_plate AS (SELECT DISTINCT user_id, day, meal, tag FROM plates JOIN {TAGS} USING (food))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, meal, rule_id FROM on_plate JOIN {RULES} USING (tag)
WHERE only_meal IS NULL OR only_meal = meal GROUP BY user_id, day, meal, rule_id, needed HAVING count(*) = needed""")
def meal_rules(spark, sf):
    return lo.meal_flags(meals(daily_logs(spark, sf)), ["user_id", "day"]).select(
        "user_id", F.col("day").cast("string").alias("day"), "meal", "rule_id")


TASTE_NAMES = [t for t, *_ in fv.TASTE_EFFECTS]


def _effect(i):
    return " + ".join(f"({t}) * ({e[i]})" for t, *e in fv.TASTE_EFFECTS)


TASTE_COLS = ", ".join(f"count(*) FILTER (WHERE taste = '{t}') AS {t}" for t in TASTE_NAMES)
EFFECT_COLS = ", ".join(f"{_effect(i)} AS {d}_effect" for i, d in enumerate(fv.DOSHAS))


@query("meal_tastes", f"""
WITH {LOGS}, {PLATES}, c AS (SELECT user_id, day, {TASTE_COLS} FROM plates LEFT JOIN {TASTES} USING (food) GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, {', '.join(TASTE_NAMES)}, {EFFECT_COLS},
       concat_ws(',', {', '.join(f"CASE WHEN {t} = 0 THEN '{t}' END" for t in TASTE_NAMES)}) AS missing_tastes FROM c""")
def meal_tastes(spark, sf):
    out = lo.taste_totals(meals(daily_logs(spark, sf)), ["user_id", "day"])
    return out.withColumn("day", F.col("day").cast("string")).withColumn("missing_tastes", F.array_join("missing_tastes", ","))


@query("weekly_profile", f"""
WITH {LOGS}, {STREAK}, {PLATES}, week AS (SELECT * FROM logs WHERE day > {TODAY_SQL} - 7),
c AS (SELECT user_id, {TASTE_COLS} FROM plates LEFT JOIN {TASTES} USING (food) WHERE day > {TODAY_SQL} - 7 GROUP BY 1)
SELECT w.user_id, w.days, w.average_score, streak, {', '.join(TASTE_NAMES)}, {EFFECT_COLS}
FROM (SELECT user_id, count(*) AS days, round_even(avg(score), 0)::BIGINT AS average_score FROM week GROUP BY 1) w LEFT JOIN streak USING (user_id) LEFT JOIN c USING (user_id)""")
def weekly_profile(spark, sf):
    logs = daily_logs(spark, sf)
    return lo.weekly_profile(logs, meals(logs), today())


_PARTS = [p for p, _ in fv.COMPLETENESS_WEIGHTS]
_FLAGS = {p: (i + 2, i % 2) for i, p in enumerate(_PARTS)}


@query("completeness", f"""
WITH f AS (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'female' WHEN c_mktsegment = 'MACHINERY' THEN 'male' END AS sex,
  {', '.join(f'c_custkey % {a} = {b} AS {p}' for p, (a, b) in _FLAGS.items())} FROM customer)
SELECT c_custkey, round_even(100.0 * ({' + '.join(f"CASE WHEN {p}{' AND sex = ' + chr(39) + 'female' + chr(39) if p == 'artava' else ''} THEN {w} ELSE 0 END" for p, w in fv.COMPLETENESS_WEIGHTS)})
  / CASE WHEN sex = 'female' THEN 110 ELSE 100 END, 0)::BIGINT AS completeness FROM f""")
def completeness(spark, sf):
    seg = F.col("c_mktsegment")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(seg.isin("BUILDING", "FURNITURE"), "female").when(seg == "MACHINERY", "male").alias("sex"),
        *[(F.col("c_custkey") % a == b).alias(p) for p, (a, b) in _FLAGS.items()])
    return lo.completeness(rows, "sex").select("c_custkey", "completeness")


@query("recommendations", f"""
WITH {s.ENCOUNTERS}, e AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'vata-kapha' WHEN id % 3 = 1 THEN 'pitta' END AS focus, id % 100 AS average,
  id % 2 = 0 AS bad, CASE WHEN id % 5 = 0 THEN 'avara' ELSE 'pravara' END AS strength, CASE WHEN id % 4 = 0 THEN 'high' ELSE 'low' END AS ama, created_at::DATE AS day FROM encounters)
SELECT id, (CASE WHEN (CASE WHEN day < DATE '2024-01-15' THEN DATE '2024-01-15' ELSE DATE '2024-03-15' END) - day <= 30 THEN 1 ELSE 0 END)
  + CASE WHEN id % 3 = 0 THEN 2 WHEN id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN average < 50 THEN 1 ELSE 0 END + CASE WHEN bad THEN 1 ELSE 0 END
  + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS applicable FROM e""")
def recommendations(spark, sf):
    e = s.encounters(spark, sf).select("id", F.to_date("created_at").alias("day"))
    nxt = lo.upcoming_seasons(e, "day", 1)
    i = F.col("id")
    tips = lo.recommendations(
        F.col("season"), F.col("days_away"), F.when(i % 3 == 0, "vata-kapha").when(i % 3 == 1, "pitta"), i % 100, i % 2 == 0,
        F.when(i % 5 == 0, "avara").otherwise("pravara"), F.when(i % 4 == 0, "high").otherwise("low"), shown=99)
    return nxt.select("id", F.size(tips).alias("applicable"))


# --- practitioner and privacy ------------------------------------------------------------------------
@query("review_queue", f"""
WITH {s.ENCOUNTERS} SELECT id, triage_level, CASE triage_level WHEN 'emergency' THEN 0 WHEN 'urgent' THEN 1 ELSE 2 END AS priority
FROM encounters WHERE status = 'submitted' AND (practitioner_id IS NULL OR practitioner_id = 'pr1') ORDER BY priority, created_at, id""")
def review_queue(spark, sf):
    return pv.review_queue(s.encounters(spark, sf), "pr1").select("id", "triage_level", "priority")


FORCE = "force AS (SELECT user_id, purpose, arg_max(granted, id) AS granted FROM consents GROUP BY 1, 2)"


@query("visible_cases", f"""
WITH {s.ENCOUNTERS}, {s.CONSENTS}, {FORCE} SELECT id, patient_id, status FROM encounters
WHERE status IN ('submitted', 'reviewed') AND (practitioner_id IS NULL OR practitioner_id = 'pr2')
  AND patient_id IN (SELECT user_id FROM force WHERE purpose = 'care' AND granted)""")
def visible_cases(spark, sf):
    return pv.visible_cases(s.encounters(spark, sf), s.consents(spark, sf), "pr2").select("id", "patient_id", "status")


ELIGIBLE = f"""{s.ENCOUNTERS}, {s.CONSENTS}, {s.REVIEWS}, {FORCE},
eligible AS (SELECT r.id AS review_id, encounter_id, patient_id, condition_id, r.created_at FROM reviews r JOIN encounters e ON e.id = encounter_id
  WHERE decision IN ('confirmed', 'revised') AND condition_id IS NOT NULL AND patient_id IN (SELECT user_id FROM force WHERE purpose = 'research' AND granted))"""


def eligible(spark, sf):
    return pv.eligible_cases(s.reviews(spark, sf), s.encounters(spark, sf), s.consents(spark, sf))


@query("eligible_cases", f"WITH {ELIGIBLE} SELECT review_id, encounter_id, patient_id, condition_id FROM eligible")
def eligible_cases(spark, sf):
    return eligible(spark, sf).drop("created_at")


@query("time_split", f"""
WITH {ELIGIBLE} SELECT review_id, CASE WHEN n < floor(0.8 * t) THEN 'train' ELSE 'holdout' END AS part FROM (
  SELECT review_id, row_number() OVER (ORDER BY created_at, review_id) - 1 AS n, count(*) OVER () AS t FROM eligible)""")
def time_split(spark, sf):
    return pv.time_split(eligible(spark, sf), ["created_at", "review_id"]).select("review_id", "part")


@query("k_anonymous", f"""
WITH {s.ENCOUNTERS}, {s.REVIEWS}, {s.CONDITIONS},
r AS (SELECT e.patient_id, ritu, desha, c.condition_id, name, body_system FROM reviews JOIN encounters e ON e.id = encounter_id
      JOIN conditions c ON c.condition_id = reviews.condition_id WHERE decision IN ('confirmed', 'revised')),
cells AS (SELECT patient_id, 'season_system' AS "table", ritu AS key1, body_system AS key2 FROM r
  UNION ALL SELECT patient_id, 'season_condition', ritu, name FROM r UNION ALL SELECT patient_id, 'habitat_dosha', desha, dosha FROM r JOIN components USING (condition_id))
SELECT "table", key1, key2, count(*) AS count, count(DISTINCT patient_id) AS people FROM cells GROUP BY 1, 2, 3 HAVING count(DISTINCT patient_id) >= 5""")
def k_anonymous(spark, sf):
    return pv.population_insights(s.reviews(spark, sf), s.encounters(spark, sf), s.conditions(spark, sf))


@query("k_anonymous_rows", f"""
WITH {s.ENCOUNTERS}, {s.REVIEWS}
SELECT ritu, condition_id, count(*) AS count, count(DISTINCT patient_id) AS people FROM reviews r JOIN encounters e ON e.id = encounter_id
WHERE condition_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""")
def k_anonymous_rows(spark, sf):
    rows = s.reviews(spark, sf).where("condition_id IS NOT NULL").select("encounter_id", "condition_id").join(
        s.encounters(spark, sf).select(F.col("id").alias("encounter_id"), "patient_id", "ritu"), "encounter_id")
    return pv.k_anonymous(rows, ["ritu", "condition_id"], "patient_id", by="rows")


@query("case_dossier", f"""
WITH {s.ENCOUNTERS}, {s.CONSENTS}, {FORCE}, {s.CONDITIONS}, {s.BRIDGE},
vis AS (SELECT * FROM encounters WHERE status IN ('submitted', 'reviewed') AND (practitioner_id IS NULL OR practitioner_id = 'pr2')
  AND patient_id IN (SELECT user_id FROM force WHERE purpose = 'care' AND granted)),
prof AS (SELECT condition_id, array_to_string(list_sort(list(symptom)), '|') AS symptoms FROM bridge GROUP BY 1)
SELECT vis.id AS encounter_id, r AS rank, c.condition_id, c.name, c.prognosis, symptoms FROM vis CROSS JOIN (SELECT unnest([1, 2, 3]) AS r)
JOIN conditions c ON c.condition_id = (top_condition + r) % 25 LEFT JOIN prof USING (condition_id)""")
def case_dossier(spark, sf):
    enc = s.encounters(spark, sf)
    visible = pv.visible_cases(enc, s.consents(spark, sf), "pr2")
    ranked = enc.select(F.col("id").alias("encounter_id"), "top_condition", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("rank"))
    differential = ranked.select("encounter_id", "rank", ((F.col("top_condition") + F.col("rank")) % 25).alias("condition_id"))
    profiles = s.bridge(spark, sf).groupBy("condition_id").agg(F.array_join(F.sort_array(F.collect_set("symptom")), "|").alias("symptoms"))
    return pv.case_dossier(visible, differential, s.conditions(spark, sf), profiles).select(
        "encounter_id", "rank", "condition_id", "name", "prognosis", "symptoms")


@query("user_export", f"""
WITH {s.ENCOUNTERS}, {s.CONSENTS}
SELECT user_id, 'consents' AS section, '{{"id":' || id || ',"purpose":"' || purpose || '"}}' AS payload FROM consents
UNION ALL SELECT patient_id, 'encounters', '{{"id":' || id || ',"status":"' || status || '"}}' FROM encounters""")
def user_export(spark, sf):
    return pv.export_rows({
        "consents": (s.consents(spark, sf).select("user_id", "id", "purpose"), "user_id"),
        "encounters": (s.encounters(spark, sf).select("patient_id", "id", "status"), "patient_id"),
    })


ERASED = "SELECT user_id FROM force WHERE purpose = 'care' AND NOT granted"


@query("erase_user", f"""
WITH {s.ENCOUNTERS}, {s.CONSENTS}, {FORCE}, {s.DAILY}
SELECT 'encounters' AS tbl, id FROM encounters WHERE patient_id NOT IN ({ERASED})
UNION ALL SELECT 'consents', id FROM consents WHERE user_id NOT IN ({ERASED}) UNION ALL SELECT 'daily', id FROM daily WHERE user_id NOT IN ({ERASED})""")
def erase_user(spark, sf):
    consents = s.consents(spark, sf)
    gone = lo.consents_in_force(consents).where("purpose = 'care' AND NOT granted").select("user_id")
    kept = pv.erase({"encounters": (s.encounters(spark, sf), "patient_id"), "consents": (consents, "user_id"),
                     "daily": (s.daily_entries(spark, sf), "user_id")}, gone)
    parts = [df.select(F.lit(name).alias("tbl"), "id") for name, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("withdraw_location", f"""
WITH {s.CONSENTS}, {FORCE}, p AS (SELECT 'u' || c_custkey AS user_id, c_acctbal AS lat, c_nationkey::DOUBLE AS lon, c_mktsegment FROM customer)
SELECT user_id, CASE WHEN coalesce(granted, true) THEN lat END AS lat, CASE WHEN coalesce(granted, true) THEN lon END AS lon, c_mktsegment
FROM p LEFT JOIN (SELECT * FROM force WHERE purpose = 'location') USING (user_id)""")
def withdraw_location(spark, sf):
    profiles = table(spark, sf, "customer").select(
        F.concat(F.lit("u"), "c_custkey").alias("user_id"), F.col("c_acctbal").alias("lat"), F.col("c_nationkey").cast("double").alias("lon"), "c_mktsegment")
    return pv.withdraw_location(profiles, s.consents(spark, sf), ["lat", "lon"])


@query("audit_rows", f"""
WITH {s.CONSENTS} SELECT user_id AS actor_id, CASE WHEN granted THEN 'consent.grant' ELSE 'consent.withdraw' END AS action, 'user' AS entity,
  user_id AS entity_id, 'purpose=' || purpose AS details FROM consents""")
def audit_rows(spark, sf):
    out = pv.audit_rows(s.consents(spark, sf), "user_id", F.when(F.col("granted"), "consent.grant").otherwise("consent.withdraw"),
                        F.lit("user"), F.col("user_id"), {"purpose": F.col("purpose")})
    return out.withColumn("details", F.concat(F.lit("purpose="), F.element_at("details", "purpose")))


# --- histories -------------------------------------------------------------------------------------------
ASSESSED = f"""{s.ENCOUNTERS}, assessed AS (SELECT *, (id % 97)::DOUBLE / 100 AS pitta, (id % 89)::DOUBLE / 100 AS kapha,
  CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'none' END AS ama, CASE WHEN id % 3 = 0 THEN 'sama' WHEN id % 3 = 1 THEN 'manda' END AS agni FROM encounters)"""
TIMELINE = """timeline AS (SELECT a.patient_id, a.id AS encounter_id, strftime(a.created_at, '%Y-%m-%d') AS date, a.ritu, a.status, a.triage_level, l.label, l.confirmed,
  CASE WHEN NOT a.stopped THEN a.vata END AS vata, CASE WHEN NOT a.stopped THEN a.pitta END AS pitta, CASE WHEN NOT a.stopped THEN a.kapha END AS kapha
  FROM assessed a JOIN (SELECT id, CASE WHEN encounter_id IS NOT NULL THEN c ELSE top_condition END AS label, encounter_id IS NOT NULL AS confirmed
    FROM encounters LEFT JOIN conf ON encounter_id = id) l USING (id))"""
HISTORY = f"""{ASSESSED}, {s.REVIEWS},
conf AS (SELECT encounter_id, condition_id AS c FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY created_at DESC, id DESC) AS n
   FROM reviews WHERE decision IN ('confirmed', 'revised')) WHERE n = 1), {TIMELINE}"""


def assessed(spark, sf):
    ama, agni = F.expr("CASE id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'none' END"), F.expr("CASE WHEN id % 3 = 0 THEN 'sama' WHEN id % 3 = 1 THEN 'manda' END")
    return s.encounters(spark, sf).select("*", ((F.col("id") % 97) / 100).alias("pitta"), ((F.col("id") % 89) / 100).alias("kapha"), ama.alias("ama"), agni.alias("agni"))


@query("patient_timeline", f"WITH {HISTORY} SELECT * FROM timeline")
def patient_timeline(spark, sf):
    return hi.timeline(lo.encounter_labels(assessed(spark, sf), s.reviews(spark, sf))).withColumn("date", F.col("date").cast("string"))


@query("season_recurrence", f"""
WITH {HISTORY}, per AS (SELECT patient_id, label, ritu, count(*) AS n FROM timeline WHERE label IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, (sum(n) OVER (PARTITION BY patient_id, label))::BIGINT AS episodes, max(n) OVER (PARTITION BY patient_id, label) >= 2 AS seasonal FROM per) WHERE episodes >= 2""")
def season_recurrence(spark, sf):
    return hi.season_counts(lo.encounter_labels(s.encounters(spark, sf), s.reviews(spark, sf)))


EFFECTS = {"vata": 5, "pitta": 7, "kapha": 11}


@query("trend_all", f"""
WITH {ASSESSED}, {LOGS},
wide AS (SELECT patient_id AS user_id, 'checkup' AS series, strftime(created_at, '%Y-%m-%d') AS at,
    unnest([{{'measure': 'vata', 'value': vata, 'level': NULL::VARCHAR}}, {{'measure': 'pitta', 'value': pitta, 'level': NULL}}, {{'measure': 'kapha', 'value': kapha, 'level': NULL}},
            {{'measure': 'ama', 'value': NULL, 'level': ama}}, {{'measure': 'agni', 'value': NULL, 'level': agni}}]) AS m FROM assessed WHERE NOT stopped
  UNION ALL SELECT user_id, 'dinacharya', strftime(day, '%Y-%m-%d'), unnest([{{'measure': 'score', 'value': score::DOUBLE, 'level': NULL::VARCHAR}},
    {', '.join(f"{{'measure': 'effect_{d}', 'value': (k % {n} - 2)::DOUBLE, 'level': NULL}}" for d, n in EFFECTS.items())}]) FROM logs
  UNION ALL SELECT 'u' || user_id, 'ojas', strftime(ts, '%Y-%m-%d'), {{'measure': 'score', 'value': (event_id % 24)::DOUBLE, 'level': NULL::VARCHAR}} FROM events WHERE event_type = 'purchase')
SELECT user_id, series, "at", m.measure AS measure, m.value AS value, m.level AS level FROM wide WHERE m.value IS NOT NULL OR m.level IS NOT NULL""")
def trend_all(spark, sf):
    effect = F.create_map(*[x for d, n in EFFECTS.items() for x in (F.lit(d), (F.col("k") % n - 2).cast("double"))])
    vitality = table(spark, sf, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("u"), "user_id").alias("user_id"), F.col("ts").alias("at"), (F.col("event_id") % 24).alias("score"))
    return hi.trends(assessed(spark, sf), daily_logs(spark, sf).withColumn("dosha_effect", effect), vitality).withColumn("at", F.col("at").cast("string"))


@query("dossier_sections", f"""
WITH {HISTORY}, {s.CONSENTS}, {FORCE}, {s.CONDITIONS}, {s.BRIDGE},
vis AS (SELECT * FROM encounters WHERE status IN ('submitted', 'reviewed') AND (practitioner_id IS NULL OR practitioner_id = 'pr2')
  AND patient_id IN (SELECT user_id FROM force WHERE purpose = 'care' AND granted)),
cases AS (SELECT id AS encounter_id, r AS rank, (top_condition + r) % 25 AS condition_id FROM vis CROSS JOIN (SELECT unnest([1, 2, 3]) AS r)),
asked AS (SELECT * FROM conditions WHERE condition_id IN (SELECT condition_id FROM cases)),
paper AS (SELECT name AS evidence_key, c_name, c_acctbal, c_custkey FROM customer JOIN conditions ON c_nationkey = condition_id),
first AS (SELECT *, row_number() OVER (PARTITION BY evidence_key ORDER BY c_acctbal DESC, c_custkey DESC) AS position FROM paper QUALIFY position <= 3)
SELECT 'cases' AS section, encounter_id::VARCHAR AS key, rank AS position, condition_id::VARCHAR AS item FROM cases
UNION ALL SELECT 'history', patient_id, 0, concat_ws('|', encounter_id, date, ritu, status, triage_level, label, confirmed) FROM timeline WHERE patient_id IN (SELECT patient_id FROM vis)
UNION ALL SELECT 'recurring', patient_id, n, concat_ws('|', label, ritu) FROM (SELECT patient_id, label, ritu, count(*)::INT AS n, sum(count(*)) OVER (PARTITION BY patient_id, label) AS e
  FROM timeline WHERE label IS NOT NULL AND patient_id IN (SELECT patient_id FROM vis) GROUP BY 1, 2, 3) WHERE e >= 2
UNION ALL SELECT 'references', condition_id::VARCHAR, 0, concat_ws('|', name, body_system, prognosis, age_low, age_high) FROM asked
UNION ALL SELECT 'symptoms', condition_id::VARCHAR, 0, symptom FROM bridge WHERE condition_id IN (SELECT condition_id FROM asked)
UNION ALL SELECT 'literature', condition_id::VARCHAR, n, name FROM asked JOIN (SELECT evidence_key, count(*)::INT AS n FROM paper GROUP BY 1) ON evidence_key = name
UNION ALL SELECT 'papers', condition_id::VARCHAR, position::INT, c_name FROM asked JOIN first ON evidence_key = name""")
def dossier_sections(spark, sf):
    enc = s.encounters(spark, sf)
    visible = pv.visible_cases(enc, s.consents(spark, sf), "pr2")
    ranked = enc.select(F.col("id").alias("encounter_id"), "top_condition", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("rank"))
    differential = ranked.select("encounter_id", "rank", ((F.col("top_condition") + F.col("rank")) % 25).alias("condition_id"))
    conditions = s.conditions(spark, sf).withColumn("evidence_key", F.col("name"))
    papers = table(spark, sf, "customer").join(conditions.select(F.col("condition_id").alias("c_nationkey"), "evidence_key"), "c_nationkey").select("evidence_key", "c_name", "c_acctbal", "c_custkey")
    literature = papers.groupBy("evidence_key").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    parts = hi.dossier(visible, differential, conditions, s.bridge(spark, sf), literature, papers, lo.encounter_labels(assessed(spark, sf), s.reviews(spark, sf)), ["c_acctbal", "c_custkey"])
    shown = {
        "cases": ("encounter_id", F.col("rank"), F.col("condition_id")),
        "history": ("patient_id", F.lit(0), F.concat_ws("|", *[F.col(c).cast("string") for c in ("encounter_id", "date", "ritu", "status", "triage_level", "label", "confirmed")])),
        "recurring": ("patient_id", F.col("n"), F.concat_ws("|", F.col("label").cast("string"), "ritu")),
        "references": ("condition_id", F.lit(0), F.concat_ws("|", *[F.col(c).cast("string") for c in ("name", "body_system", "prognosis", "age_low", "age_high")])),
        "symptoms": ("condition_id", F.lit(0), F.col("symptom")),
        "literature": ("condition_id", F.col("hits"), F.col("evidence_key")),
        "papers": ("condition_id", F.col("position"), F.col("c_name")),
    }
    out = None
    for name, (key, position, item) in shown.items():
        part = parts[name].select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), position.cast("int").alias("position"), item.cast("string").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out
