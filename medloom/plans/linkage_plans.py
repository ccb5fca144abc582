"""Linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..operators import linkage as ln
from . import standins as s
from .base import query, sql_values, table
from .text_plans import tidy_sql


def phonetic_sql(c):
    t = f"regexp_replace(lower(strip_accents(string_split({c}, '(')[1])), '[^a-z]', '', 'g')"
    t = f"regexp_replace({t}, '(ah|h|am|m)$', '')"
    for a, b in fv.PHONETIC_FOLDS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_replace({t}, 'a+$', '')"


WORDS = "words AS (SELECT unnest(regexp_extract_all(text, '[a-zA-ZàâçéèêëîïôùûüñáíóúäöÀÉÈ]+')) AS w FROM {0})"


def words(df, col="text"):
    return df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit("[a-zA-ZàâçéèêëîïôùûüñáíóúäöÀÉÈ]+"), F.lit(0))).alias("w"))


@query("lnk_phonetic", f"""
WITH {WORDS.format('documents')}, d AS (SELECT w, count(*) AS n FROM words GROUP BY 1)
SELECT key, count(*) AS spellings, sum(n)::BIGINT AS uses FROM (SELECT {phonetic_sql('w')} AS key, n FROM d) GROUP BY 1""")
def lnk_phonetic(spark, sf):
    spelled = words(s.documents(spark, sf)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return spelled.groupBy(tx.phonetic_key(F.col("w")).alias("key")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("uses"))


def grams_sql(src, key, lo, hi):
    """Plain character grams of every key: (key, gram, tf)."""
    return (f"SELECT {key} AS key, gram, count(*) AS tf FROM (SELECT {key}, unnest(list_transform(generate_series(1, length({key}) - n + 1), lambda i: substr({key}, i, n))) AS gram "
            f"FROM {src} CROSS JOIN (SELECT unnest(generate_series({lo}, {hi})) AS n) WHERE length({key}) >= n) GROUP BY 1, 2")


@query("lnk_terms", f"""
WITH {WORDS.format('benchmark')}, names AS (SELECT DISTINCT w AS name, {phonetic_sql('w')} AS k FROM words),
rw AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-ZàâçéèêëîïôùûüñáíóúäöÀÉÈ]+')) AS w FROM documents) GROUP BY 1),
refs AS (SELECT {phonetic_sql('w')} AS key, arg_min(w, w) AS term FROM rw GROUP BY 1 HAVING length(key) >= 3),
openk AS (SELECT DISTINCT k FROM names WHERE length(k) >= 4 AND k NOT IN (SELECT key FROM refs)),
rg AS ({grams_sql('refs', 'key', 2, 3)}), wt AS (SELECT gram, ln((1 + (SELECT count(*) FROM refs))::DOUBLE / (1 + count(*))) + 1 AS idf FROM rg GROUP BY 1),
qg AS ({grams_sql('openk', 'k', 2, 3)}),
rv AS (SELECT key, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY key)) AS w FROM rg JOIN wt USING (gram)),
qv AS (SELECT key AS k, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY key)) AS w FROM qg JOIN wt USING (gram)),
sc AS (SELECT k, rv.key, sum(qv.w * rv.w) AS score FROM qv JOIN rv USING (gram) GROUP BY 1, 2 HAVING sum(qv.w * rv.w) >= 0.8),
best AS (SELECT k, key, score, term FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, term) AS n FROM sc JOIN refs USING (key)) WHERE n = 1),
ok AS (SELECT *, left(k, 3) = left(key, 3) AND contains(k, 'wata') = contains(key, 'wata') AND contains(k, 'pitta') = contains(key, 'pitta')
   AND contains(k, 'kapa') = contains(key, 'kapa') AND contains(k, 'sannipat') = contains(key, 'sannipat') AS agree FROM best)
SELECT name, coalesce(refs.term, CASE WHEN agree THEN ok.term END) AS term,
       CASE WHEN refs.term IS NOT NULL THEN 'exact' WHEN agree THEN 'fuzzy' ELSE 'unlinked' END AS tier,
       CASE WHEN refs.term IS NOT NULL THEN 1.0 ELSE round(score, 5) END::DOUBLE AS score
FROM names LEFT JOIN refs ON refs.key = names.k LEFT JOIN ok ON ok.k = names.k""")
def lnk_terms(spark, sf):
    docs = s.documents(spark, sf)
    each = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-zA-ZàâçéèêëîïôùûüñáíóúäöÀÉÈ]+"), F.lit(0)))).alias("w"))
    known = each.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    out = ln.link_terms(words(table(spark, sf, "benchmark")), "w", known, "w", "w", "w")
    return out.select("name", "term", "tier", F.round("score", 5).alias("score"))


GEO = ["India", "South East Asia", "Asia", "Worldwide", "Europe", "United States", "Africa"]
CLASSES = [c for c, _ in fv.PREVALENCE_CLASSES] + ["Unknown", "Not yet documented", "None"]
TYPES = list(fv.TYPE_PREFERENCE)
PREV = f"""prev AS (SELECT l_suppkey * 7 + l_linenumber AS orphacode, {GEO}[1 + (l_partkey % 7)] AS geography, {TYPES}[1 + (l_orderkey % 5)] AS type,
  {CLASSES}[1 + CAST(round(l_tax * 100) AS INT)] AS class, l_orderkey * 1000 + l_partkey AS pos FROM lineitem)"""
PRIORS = f"""{PREV},
usable AS (SELECT p.*, CASE WHEN type = 'Cases/families' THEN 2e-7 ELSE mid END AS p, CASE WHEN type = 'Cases/families' THEN 'case reports only' ELSE p.class END AS cls, g_rank, t_rank
  FROM prev p JOIN {sql_values([(g, i) for i, g in enumerate(fv.GEOGRAPHY_PREFERENCE)], 'geography, g_rank', 'gg')} USING (geography)
  JOIN {sql_values([(t, i) for i, t in enumerate(TYPES)], 'type, t_rank', 'tt')} USING (type)
  LEFT JOIN {sql_values(fv.PREVALENCE_CLASSES, 'c, mid', 'cc')} ON c = p.class WHERE type = 'Cases/families' OR mid IS NOT NULL),
priors AS (SELECT orphacode, round(least(1.0, sqrt(p / 1e-3)), 4) AS weight, cls AS class, geography, type FROM (
  SELECT *, row_number() OVER (PARTITION BY orphacode ORDER BY g_rank, t_rank, pos, cls) AS n FROM usable) WHERE n = 1)"""


def prevalence(spark, sf):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") * 7 + F.col("l_linenumber")).alias("orphacode"), pick(GEO, F.col("l_partkey") % 7).alias("geography"),
        pick(TYPES, F.col("l_orderkey") % 5).alias("type"), pick(CLASSES, F.round(F.col("l_tax") * 100)).alias("class"),
        (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("pos"))


@query("lnk_preference_pick", f"WITH {PRIORS} SELECT orphacode, weight, class, geography, type FROM priors")
def lnk_preference_pick(spark, sf):
    return ln.prevalence_priors(prevalence(spark, sf))


GENERIC = ", ".join(f"'{g}'" for g in fv.GENERIC_SUFFIXES)
NAME = "p_name || CASE p_size % 5 WHEN 0 THEN ' disease' WHEN 1 THEN ' fever syndrome' WHEN 2 THEN ' Type-' || p_size ELSE '' END"
PIECES = "string_split_regex({0}, '\\s*/\\s*|\\s*\\(\\s*|\\)')"
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query("lnk_name_lookup", f"""
WITH names AS (SELECT p_partkey AS orphacode, {NORM.format(NAME)} AS key FROM part),
ful AS (SELECT key, arg_min(orphacode, orphacode) AS code FROM names GROUP BY 1),
ws AS (SELECT orphacode, string_split(key, ' ') AS w FROM names),
ks AS (SELECT orphacode, w, unnest(generate_series(1, len(w) - 1)) AS k FROM ws WHERE len(w) > 1),
short AS (SELECT orphacode, array_to_string(w[1:k], ' ') AS key FROM ks WHERE len(list_filter(w[k + 1:], lambda x: x NOT IN ({GENERIC}))) = 0),
single AS (SELECT key, min(orphacode) AS code FROM short GROUP BY 1 HAVING count(DISTINCT orphacode) = 1),
look AS (SELECT * FROM ful UNION ALL SELECT * FROM single WHERE key NOT IN (SELECT key FROM ful)),
parts AS (SELECT p_partkey AS condition_id, unnest(list_concat({PIECES.format("p_brand || ' (' || p_name || ')'")}, {PIECES.format("p_name || ' fever / ' || p_type")})) AS part,
  unnest(generate_series(1, len(list_concat({PIECES.format("p_brand || ' (' || p_name || ')'")}, {PIECES.format("p_name || ' fever / ' || p_type")})))) AS pos FROM part),
hits AS (SELECT condition_id, arg_min(code, pos) AS orphacode FROM (SELECT condition_id, pos, {NORM.format('part')} AS key FROM parts) JOIN look USING (key) WHERE length(key) > 3 GROUP BY 1)
SELECT p_partkey AS condition_id, CASE WHEN orphacode % 3 <> 0 THEN orphacode / 8.0 END::DOUBLE AS weight FROM part LEFT JOIN hits ON condition_id = p_partkey""")
def lnk_name_lookup(spark, sf):
    part = table(spark, sf, "part")
    suffix = F.when(F.col("p_size") % 5 == 0, " disease").when(F.col("p_size") % 5 == 1, " fever syndrome").when(
        F.col("p_size") % 5 == 2, F.concat(F.lit(" Type-"), "p_size")).otherwise("")
    names = part.select(F.col("p_partkey").alias("orphacode"), F.concat("p_name", suffix).alias("name"), F.col("p_partkey").alias("pos"))
    conditions = part.select(F.col("p_partkey").alias("condition_id"), F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")")).alias("name"),
                             F.concat("p_name", F.lit(" fever / "), "p_type").alias("modern_equivalent"))
    priors = part.where("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("orphacode"), (F.col("p_partkey") / F.lit(8.0)).alias("weight"), F.lit("c").alias("class"),
        F.lit("g").alias("geography"), F.lit("t").alias("type"))
    return ln.link_conditions(conditions, names, priors).select("condition_id", "weight")


LIT = """lit AS (SELECT s_name AS evidence_key, count(*) AS hits_all, count(*) FILTER (WHERE l_discount = 0.05 AND l_tax < 0.03) AS hits_region
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)"""


def literature(spark, sf):
    hits = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("hits_all"), F.count_if((F.col("l_discount") == 0.05) & (F.col("l_tax") < 0.03)).alias("hits_region"))
    return hits.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("evidence_key")), "l_suppkey")


@query("lnk_condition_prior", f"""
WITH {LIT}, {PRIORS},
c AS (SELECT s_suppkey AS condition_id, s_name AS evidence_key, s_suppkey % 3 <> 0 AS modern, s_suppkey % 2 = 0 AS endemic FROM supplier)
SELECT condition_id, round(coalesce(weight, 1.0) * CASE WHEN modern AND endemic AND hits_all >= 30 THEN
   round(greatest(0.2, least(1.0, sqrt(hits_region::DOUBLE / hits_all / 0.03))), 4) ELSE 1.0 END, 4) AS prior_weight
FROM c LEFT JOIN priors ON orphacode = condition_id LEFT JOIN lit USING (evidence_key)""")
def lnk_condition_prior(spark, sf):
    key = F.col("s_suppkey")
    conditions = table(spark, sf, "supplier").select(
        key.alias("condition_id"), F.col("s_name").alias("evidence_key"), F.concat("s_name", F.when(key % 2 == 0, " fever").otherwise("")).alias("name"),
        F.when(key % 3 != 0, "condition_kb_modern").otherwise("condition_kb_classical").alias("source"))
    priors = ln.prevalence_priors(prevalence(spark, sf)).select(F.col("orphacode").alias("condition_id"), "weight")
    return ln.condition_prior(conditions, priors, literature(spark, sf))


@query("lnk_evidence", f"""
WITH {LIT} SELECT evidence_key, hits_all FROM lit WHERE evidence_key IN (SELECT s_name FROM supplier WHERE s_acctbal > 1000)""")
def lnk_evidence(spark, sf):
    used = table(spark, sf, "supplier").where("s_acctbal > 1000").select(F.col("s_name").alias("evidence_key"))
    return ln.evidence_papers(literature(spark, sf), used).select("evidence_key", "hits_all")


SYN = sql_values(fv.SYNONYMS.items(), "phrase, preferred", "syn")
STOP = ", ".join(f"'{d}'" for d in fv.DESCRIPTORS)


def wb_grams_sql(src, key):
    return (f"SELECT key, gram, count(*) AS tf FROM (SELECT key, unnest(list_transform(generate_series(1, length(w) - n + 1), lambda i: substr(w, i, n))) AS gram FROM "
            f"(SELECT {key} AS key, ' ' || unnest(string_split({key}, ' ')) || ' ' AS w FROM {src}) CROSS JOIN (SELECT unnest([2, 3, 4]) AS n) WHERE length(w) >= n) GROUP BY 1, 2")


RAW = """CASE p_size % 6 WHEN 0 THEN 'Severe ' || p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN replace(p_name, 'o', 'oo') WHEN 3 THEN left(p_name, length(p_name) - 2)
  WHEN 4 THEN p_type || p_size ELSE upper(p_name) || '!!' END"""


@query("txt_free_text", f"""
WITH vocab AS (SELECT p_name AS term, count(*) AS df FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
keys AS (SELECT term AS key, term FROM vocab UNION ALL SELECT replace(term, ' ', ' the '), term FROM vocab),
tidy AS (SELECT p_partkey, trim(lower({RAW})) AS plain, {tidy_sql(f'trim(lower({RAW}))')} AS p FROM part),
q AS (SELECT p_partkey, CASE WHEN length(n) >= 3 AND n NOT IN ({STOP}) AND NOT regexp_matches(n, '^[0-9]+$') THEN n ELSE plain END AS phrase
      FROM (SELECT p_partkey, plain, coalesce(preferred, p) AS n FROM tidy LEFT JOIN {SYN} ON phrase = p)),
rest AS (SELECT DISTINCT phrase FROM q WHERE phrase NOT IN (SELECT key FROM keys) AND phrase <> ''),
kg AS ({wb_grams_sql('keys', 'key')}), qg AS ({wb_grams_sql('rest', 'phrase')}),
wt AS (SELECT gram, ln((1 + (SELECT count(*) FROM keys))::DOUBLE / (1 + count(*))) + 1 AS idf FROM kg GROUP BY 1),
kv AS (SELECT key, gram, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS w FROM (SELECT key, gram, (1 + ln(tf)) * idf AS v FROM kg JOIN wt USING (gram))),
qv AS (SELECT key AS phrase, gram, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS w FROM (SELECT key, gram, (1 + ln(tf)) * idf AS v FROM qg JOIN wt USING (gram))),
sc AS (SELECT phrase, kv.key, sum(qv.w * kv.w) AS score FROM qv JOIN kv USING (gram) GROUP BY 1, 2
  UNION ALL SELECT phrase, key, 0.9 FROM rest JOIN keys ON starts_with(key, phrase)),
best AS (SELECT phrase, term FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY round(score, 9) DESC, df DESC, term) AS n FROM (
   SELECT phrase, term, max(score) AS score FROM sc JOIN keys USING (key) GROUP BY 1, 2) JOIN vocab USING (term)) WHERE n = 1 AND round(score, 3) >= 0.55)
SELECT p_partkey, coalesce(keys.term, best.term) AS matched FROM q LEFT JOIN keys ON keys.key = q.phrase LEFT JOIN best ON best.phrase = q.phrase""")
def txt_free_text(spark, sf):
    part = table(spark, sf, "part")
    vocab = part.where("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("df")).withColumn(
        "aliases", F.array(F.replace("term", F.lit(" "), F.lit(" the "))))
    return ln.match_free_text(part.select("p_partkey", F.expr(RAW).alias("raw")), "raw", vocab).select("p_partkey", "matched")
