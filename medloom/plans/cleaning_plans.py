"""Projection and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators import cleaning as c
from ..operators.skew import spread
from . import standins as s
from .base import query, sql_values, table

SALT = "test-salt"
IPAD, OPAD = tx.hmac_pads(SALT)
FOLD = "replace(lower({0}), 'ß', 'ss')"


def hmac_sql(message: str, length: int) -> str:
    inner = f"sha256(unhex('{IPAD}') || encode({message}))"
    return f"'p_' || substr(sha256(unhex('{OPAD}') || unhex({inner})), 1, {length})"


def canonical_sql(text: str) -> str:
    return f"trim(regexp_replace({FOLD.format(text)}, '\\s+', ' ', 'g'))"


def code_sql(text: str) -> str:
    t = FOLD.format(text)
    named = "concat_ws('-', " + ", ".join(f"CASE WHEN contains({t}, '{d}') THEN '{d}' END" for d in fv.DOSHAS) + ")"
    return (f"CASE WHEN contains({t}, 'tridosha') OR contains({t}, 'sannipata') THEN 'tridosha' "
            f"WHEN {named} = 'vata-pitta-kapha' THEN 'tridosha' ELSE nullif({named}, '') END")


# Spellings the driver tables do not hold are made from the column values themselves.
RAW_CODE = """CASE p_size % 9 WHEN 0 THEN 'Vata' WHEN 1 THEN 'Pitta/' || p_name WHEN 2 THEN 'KAPHA, vata'
  WHEN 3 THEN 'Tridosha' WHEN 4 THEN 'Vata/Pitta/Kapha' WHEN 5 THEN p_type WHEN 6 THEN NULL
  WHEN 7 THEN 'sannipataja' ELSE 'kapha+' || p_brand END"""


@query("prj_canonical_code", f"""
SELECT p_partkey, {code_sql('raw')} AS code,
       CASE WHEN {code_sql('raw')} IS NULL THEN 0 WHEN {code_sql('raw')} = 'tridosha' THEN 3
            ELSE length({code_sql('raw')}) - length(replace({code_sql('raw')}, '-', '')) + 1 END AS n_components
FROM (SELECT p_partkey, {RAW_CODE} AS raw FROM part)""")
def prj_canonical_code(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(RAW_CODE).alias("raw"))
    coded = rows.select("p_partkey", tx.dosha_code(F.col("raw")).alias("code"))
    return coded.withColumn("n_components", F.size(tx.dosha_components(F.col("code"))))


ALIASES = sql_values([(a, sysname, i) for i, (a, sysname) in enumerate(fv.SYSTEM_ALIASES)], "alias, system, pos", "al")


@query("prj_body_system", f"""
WITH tokens AS (
  SELECT conv_id, turn, unnest(string_split_regex({FOLD.format('text')}, '[/,&]| and ')) AS token,
         generate_subscripts(string_split_regex({FOLD.format('text')}, '[/,&]| and '), 1) AS pos FROM conversations),
hits AS (SELECT conv_id, turn, arg_min(system, tokens.pos * 1000 + al.pos) AS system
         FROM tokens JOIN {ALIASES} ON contains(token, alias) GROUP BY ALL)
SELECT conv_id, turn, coalesce(system, 'other') AS system FROM conversations LEFT JOIN hits USING (conv_id, turn)""")
def prj_body_system(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.body_system(F.col("text")).alias("system"))


RAW_COHORT = """
  SELECT o_orderkey AS record_id, o_custkey AS patient_key,
         CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE (o_custkey % 63 + 18)::VARCHAR END AS age_raw,
         ' ' || c_mktsegment AS gender_raw,
         CASE o_custkey % 4 WHEN 0 THEN 'Vata' WHEN 1 THEN 'pitta-vata' WHEN 2 THEN 'i don''t know' END AS prakriti,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN 'no' WHEN '3-MEDIUM' THEN 'I prefer not to say' ELSE '' END AS family,
         CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No ' ELSE 'declined' END AS dx
  FROM orders JOIN customer ON c_custkey = o_custkey"""


@query("prj_typed_cohort", f"""
WITH raw AS ({RAW_COHORT})
SELECT record_id, coalesce(try_cast(age_raw AS BIGINT), -1) AS age, trim(lower(gender_raw)) AS gender, {code_sql('prakriti')} AS dosha,
       CASE WHEN trim(lower(family)) IN ('i prefer not to say', '') THEN 'unknown' ELSE trim(lower(family)) END AS family_history,
       CASE trim(lower(dx)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 ELSE -1 END::BIGINT AS diabetes
FROM raw""")
def prj_typed_cohort(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    pri, st, cust = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")
    raw = o.select(
        F.col("o_orderkey").alias("record_id"), cust.alias("patient_key"),
        F.when(F.col("o_orderkey") % 17 == 0, "unknown").otherwise((cust % 63 + 18).cast("string")).alias("Age"),
        F.concat(F.lit(" "), "c_mktsegment").alias("Gender"),
        F.when(cust % 4 == 0, "Vata").when(cust % 4 == 1, "pitta-vata").when(cust % 4 == 2, "i don't know").alias("Prakriti"),
        F.lit("vegan").alias("Diet"), F.lit("regular").alias("Meal Timing"), F.lit("no").alias("Exercise"),
        F.lit("7").alias("Sleep Hours/Night"), F.lit("good").alias("Sleep Quality"), F.lit("regular").alias("Daily Routine"),
        F.lit("3").alias("Stress Level"), F.lit("sweet, sour").alias("Food Preferences"),
        F.when(pri == "1-URGENT", "Yes").when(pri == "2-HIGH", "no").when(pri == "3-MEDIUM", "I prefer not to say").otherwise("").alias("Family History of Diabetes"),
        F.when(st == "F", "Yes").when(st == "O", "No ").otherwise("declined").alias("Diabetes Diagnosis"),
    )
    known = lambda name: F.coalesce(F.col(name), F.lit(-1)).alias(name)
    return c.clean_intake(raw).select("record_id", known("age"), "gender", "dosha", "family_history", known("diabetes"))


TOKENS = ("anvil", "blue", "bolt", "gear", "hot", "red")


@query("prj_multi_select", f"""
SELECT p_partkey, {', '.join(f"list_contains(string_split(p_name, ' '), '{t}') AS pref_{t}" for t in TOKENS)} FROM part""")
def prj_multi_select(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("prefs"))
    return c.preference_flags(rows, "prefs", list(TOKENS)).drop("prefs")


@query("prj_assessment", f"""
SELECT l_orderkey * 10 + l_linenumber AS assessment_id, l_returnflag, l_linestatus,
       CASE l_returnflag WHEN 'A' THEN 'vata' WHEN 'R' THEN 'pitta' ELSE 'kapha' END AS dosha FROM lineitem""")
def prj_assessment(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Row No"),
        F.col("l_returnflag").alias("L Returnflag"), F.col("l_linestatus").alias("L-LineStatus".lower().replace("-linestatus", " linestatus")),
        F.when(F.col("l_returnflag") == "A", "Vata ").when(F.col("l_returnflag") == "R", "PITTA").otherwise("Kapha").alias("Dosha"),
    )
    return c.clean_assessment(raw, "Row No")


@query("prj_pseudonym", f"""
SELECT c_custkey, {hmac_sql(canonical_sql("'  ' || c_name || '  ' || c_mktsegment"), 16)} AS patient_key FROM customer""")
def prj_pseudonym(spark, sf):
    text = F.concat_ws("  ", F.lit(""), "c_name", "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", tx.pseudonym(text, SALT, ascii_only=True).alias("patient_key"))


@query("prj_scrub", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, d) AS n
           FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS d FROM events))
SELECT {hmac_sql(canonical_sql("user_id || '|' || event_type || '|' || d || '|' || n"), 20)} AS record_id,
       {hmac_sql(canonical_sql("user_id || '|' || event_type"), 16)} AS patient_key, event_type, d FROM r""")
def prj_scrub(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("d"))
    return c.scrub(rows, ["user_id"], SALT, ["user_id", "event_type"], ascii_only=True)


AGE = "regexp_extract({t}, '(\\d{{1,2}})\\s*[-–to]+\\s*(\\d{{1,3}})', {g})"
_T = FOLD.format("text")
_LOW, _HIGH = AGE.format(t=_T, g=1), AGE.format(t=_T, g=2)
_PLUS = f"regexp_extract({_T}, '(\\d{{1,2}})\\s*\\+', 1)"
_LOWS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_T}, '{p}') THEN {lo} END" for p, lo, _ in fv.AGE_WORDS) + "], lambda x: x IS NOT NULL)"
_HIGHS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_T}, '{p}') THEN {hi} END" for p, _, hi in fv.AGE_WORDS) + "], lambda x: x IS NOT NULL)"


def _age_sql(side, word, default):
    value = _LOW if side == "low" else _HIGH
    plus = f"{_PLUS}::INT" if side == "low" else "120"
    return (f"CASE WHEN regexp_matches({_T}, 'any age|all age') THEN {default} WHEN {_LOW} <> '' THEN {value}::INT "
            f"WHEN {_PLUS} <> '' THEN {plus} WHEN len({_LOWS}) > 0 THEN {word} ELSE {default} END")


_FEM = f"regexp_matches({_T}, '{fv.FEMALE_WORDS}')"
_MAL = f"regexp_matches({_T}, '(^|[^a-z])(males?|men)([^a-z]|$)|prostat')"
_LEAN = f"(regexp_matches({_T}, '{fv.LEANING_WORDS}') OR contains({_T}, 'any'))"
_FONLY = f"regexp_matches({_T}, 'females? only|exclusively')"
_MONLY = f"regexp_matches({_T}, '(^|[^e]|[^f]e)males? only')"


@query("prj_age_sex", f"""
SELECT id, {_age_sql('low', f'list_min({_LOWS})', 0)} AS low, {_age_sql('high', f'list_max({_HIGHS})', 120)} AS high,
  CASE WHEN {_FEM} AND {_MAL} THEN CASE WHEN {_FONLY} THEN 1.0 WHEN {_MONLY} THEN 0.02 ELSE 1.0 END
       WHEN {_FEM} THEN 1.0 WHEN {_MAL} THEN CASE WHEN {_LEAN} THEN 0.6 ELSE 0.02 END ELSE 1.0 END::DOUBLE AS female,
  CASE WHEN {_FEM} AND {_MAL} THEN CASE WHEN {_FONLY} THEN 0.02 ELSE 1.0 END
       WHEN {_FEM} THEN CASE WHEN {_LEAN} THEN 0.6 ELSE 0.02 END ELSE 1.0 END::DOUBLE AS male
FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)""")
def prj_age_sex(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    both = spread(d.unionByName(p)).select("id", c.age_range(F.col("text")).alias("a"), c.sex_weight(F.col("text")).alias("w"))
    return both.select("id", "a.low", "a.high", "w.female", "w.male")


@query("prj_query_key", f"""
SELECT page_id, trim(coalesce(
  list_filter(parts, lambda p: lower(p) NOT IN ({', '.join(f"'{x}'" for x in fv.KEY_QUALIFIERS)}))[1], parts[1], head)) AS query_key
FROM (SELECT page_id, head, list_filter(list_transform(string_split(head, '/'), lambda p: trim(p)), lambda p: p <> '') AS parts
      FROM (SELECT page_id, string_split_regex(replace(url, 'http', 'acute/chronic'), '\\s*\\(')[1] AS head FROM pages))""")
def prj_query_key(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", c.query_key(F.replace("url", F.lit("http"), F.lit("acute/chronic"))).alias("query_key"))


_ENDEMIC_RE2 = fv.ENDEMIC_PATTERN.replace("(?<!psor)(?<!lith)(?<!ondr)iasis|", "")


@query("prj_endemic_regional", f"""
SELECT l_suppkey, hits_all, hits_region,
       CASE WHEN hits_all < 30 THEN 1.0 ELSE round(greatest(0.2, least(1.0, sqrt(hits_region::DOUBLE / hits_all / 0.03))), 4) END::DOUBLE AS weight,
       regexp_matches(s_name || ' ' || hits_all || ' fever', '{_ENDEMIC_RE2}') AS endemic
FROM (SELECT l_suppkey, count(*) AS hits_all, count(*) FILTER (WHERE l_discount = 0.05 AND l_tax < 0.03) AS hits_region FROM lineitem GROUP BY 1)
JOIN supplier ON s_suppkey = l_suppkey""")
def prj_endemic_regional(spark, sf):
    hits = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("hits_all"), F.count_if((F.col("l_discount") == 0.05) & (F.col("l_tax") < 0.03)).alias("hits_region"))
    named = hits.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    text = F.concat_ws(" ", "s_name", F.col("hits_all").cast("string"), F.lit("fever"))
    return named.select("l_suppkey", "hits_all", "hits_region",
                        c.regional_weight(F.col("hits_all"), F.col("hits_region")).alias("weight"),
                        c.is_endemic_type(text).alias("endemic"))


@query("prj_location_cell", """
SELECT cell, count(*) AS n FROM (
  SELECT printf('%.1f,%.1f', round(floor(c_acctbal / 10) / 10 + 0.02, 1), round(c_nationkey * 7 - 80 + 0.31, 1)) AS cell FROM customer) GROUP BY 1""")
def prj_location_cell(spark, sf):
    lat = F.floor(F.col("c_acctbal") / 10) / 10 + 0.02
    lon = F.col("c_nationkey") * 7 - 80 + F.lit(0.31)
    return table(spark, sf, "customer").select(c.location_cell(lat, lon).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("prj_age_on", """
SELECT l_orderkey, l_linenumber,
       year(l_shipdate) - year(dob) - (month(l_shipdate) * 100 + day(l_shipdate) < month(dob) * 100 + day(dob))::INT AS age
FROM (SELECT *, o_orderdate::DATE - CAST(o_custkey AS INTEGER) AS dob FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def prj_age_on(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey"), "l_orderkey")
    dob = F.date_sub(F.to_date("o_orderdate"), F.col("o_custkey").cast("int"))
    return rows.select("l_orderkey", "l_linenumber", c.age_on(dob, F.to_date("l_shipdate")).alias("age"))


_ANS = f"""ans AS (SELECT user_id, event_id AS at_id,
  CASE WHEN event_type = 'view' THEN 'dashavidha' ELSE 'agni_mala' END AS module,
  CASE event_type WHEN 'view' THEN CASE WHEN {s.K} % 2 = 0 THEN 'height_cm' ELSE 'weight_kg' END
    WHEN 'click' THEN 'stool' WHEN 'error' THEN 'urine' ELSE 'agni' END AS question,
  CASE event_type WHEN 'click' THEN CASE {s.K} % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'hard_dry' ELSE 'sticky_heavy' END
    WHEN 'error' THEN CASE {s.K} % 2 WHEN 0 THEN 'normal' ELSE 'scanty_clear' END
    WHEN 'view' THEN NULL ELSE CASE {s.K} % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'sharp' ELSE 'balanced' END END AS opt,
  CASE WHEN event_type = 'view' THEN CASE WHEN {s.K} % 2 = 0 THEN 150 + {s.K} % 40 ELSE 45 + {s.K} END END::DOUBLE AS num
  FROM events)"""


@query("prj_profile_signals", f"""
WITH {_ANS}
SELECT user_id, nullif(stool, 'normal') AS mala, nullif(urine, 'normal') AS mutra,
       CASE agni_answer WHEN 'slow' THEN 'slow_heavy_after_meals' WHEN 'sharp' THEN 'sharp_frequent_hunger' ELSE agni_answer END AS agni,
       round(weight / pow(height / 100, 2), 1) AS bmi
FROM (SELECT user_id, arg_max(opt, at_id) FILTER (WHERE question = 'stool') AS stool, arg_max(opt, at_id) FILTER (WHERE question = 'urine') AS urine,
             arg_max(opt, at_id) FILTER (WHERE question = 'agni') AS agni_answer, arg_max(num, at_id) FILTER (WHERE question = 'height_cm') AS height,
             arg_max(num, at_id) FILTER (WHERE question = 'weight_kg') AS weight FROM ans GROUP BY 1)""")
def prj_profile_signals(spark, sf):
    e, k, t = s.events(spark, sf), F.col("k"), F.col("event_type")
    answers = e.select(
        "user_id", F.col("event_id").alias("at"),
        F.when(t == "view", "dashavidha").otherwise("agni_mala").alias("module"),
        F.when(t == "view", F.when(k % 2 == 0, "height_cm").otherwise("weight_kg")).when(t == "click", "stool").when(t == "error", "urine").otherwise("agni").alias("question"),
        F.when(t == "click", F.when(k % 3 == 0, "normal").when(k % 3 == 1, "hard_dry").otherwise("sticky_heavy"))
        .when(t == "error", F.when(k % 2 == 0, "normal").otherwise("scanty_clear"))
        .when(t != "view", F.when(k % 3 == 0, "slow").when(k % 3 == 1, "sharp").otherwise("balanced")).alias("option"),
        F.when(t == "view", F.when(k % 2 == 0, 150 + k % 40).otherwise(45 + k)).cast("double").alias("number"),
    )
    return c.profile_signals(answers, "user_id", "module", "question", "option", "at", "number")
