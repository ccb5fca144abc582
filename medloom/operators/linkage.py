"""Record linkage: phonetic terminology codes, prevalence priors, literature, free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv
from ..functions.text import fold_case, norm_name, phonetic_key, phonetic_tags
from .cleaning import is_endemic_type, regional_weight
from .similarity import char_grams, gram_weights, similar_to_reference, unit_vectors
from .skew import lookup
from .vocabulary import normalize_terms


# --- terminology codes -------------------------------------------------------------------------------
def link_terms(names: DataFrame, name: str, reference: DataFrame, code: str, term: str, order: str,
               threshold: float = fv.LINK_SIMILARITY) -> DataFrame:
    """(name, code, term, tier, score) per distinct name.

    Identical phonetic key first; otherwise the single most similar key, accepted only when both
    begin alike and carry the same dosha tags. Names below the threshold stay unlinked.
    """
    ref = reference.select(F.col(code).alias("code"), F.col(term).alias("term"), F.col(order).alias("_o")).withColumn(
        "key", phonetic_key(F.col("term"))).where(F.length("key") >= 3)
    ref = ref.groupBy("key").agg(F.min_by(F.struct("code", "term", "_o"), "_o").alias("r")).select("key", "r.*")
    wanted = names.select(F.col(name).alias("name")).distinct().withColumn("k", phonetic_key(F.col("name")))
    exact = wanted.join(ref.select(F.col("key").alias("k"), F.col("code").alias("e_code"), F.col("term").alias("e_term")), "k", "left")

    open_keys = exact.where("e_code IS NULL AND length(k) >= 4").select("k").distinct()
    ref_grams = char_grams(ref, "key", 2, 3, boundaries=False)
    weights = gram_weights(ref_grams, ref.agg(F.count(F.lit(1)).alias("n")))
    scored = similar_to_reference(
        unit_vectors(char_grams(open_keys, "k", 2, 3, boundaries=False), weights, sublinear=False),
        unit_vectors(ref_grams, weights, sublinear=False), threshold,
    ).join(ref.select(F.col("key").alias("term"), "code", F.col("term").alias("r_term"), "_o"), "term")
    best = scored.groupBy(F.col("query").alias("k")).agg(
        F.min_by(F.struct("code", F.col("r_term").alias("term"), F.col("term").alias("key"), "score"),
                 F.struct(-F.round("score", 9), F.col("_o"))).alias("b"))
    agree = (F.substring("k", 1, 3) == F.substring("b.key", 1, 3)) & (phonetic_tags(F.col("k")) == phonetic_tags(F.col("b.key")))
    joined = exact.join(best, "k", "left")
    fuzzy = F.coalesce(agree, F.lit(False))
    return joined.select(
        "name",
        F.coalesce("e_code", F.when(fuzzy, F.col("b.code"))).alias("code"),
        F.coalesce("e_term", F.when(fuzzy, F.col("b.term"))).alias("term"),
        F.when(F.col("e_code").isNotNull(), "exact").when(fuzzy, "fuzzy").otherwise("unlinked").alias("tier"),
        F.when(F.col("e_code").isNotNull(), F.lit(1.0)).otherwise(F.col("b.score")).alias("score"),
    )


# --- prevalence ---------------------------------------------------------------------------------------
def prevalence_priors(prevalence: DataFrame, code: str = "orphacode", position: str = "pos") -> DataFrame:
    """(code, weight, class, geography, type): the most local, most direct usable estimate."""
    spark = prevalence.sparkSession
    geo = dims.dim(spark, [(g, i) for i, g in enumerate(fv.GEOGRAPHY_PREFERENCE)], "geography string, g_rank int")
    kind = dims.dim(spark, [(t, i) for i, t in enumerate(fv.TYPE_PREFERENCE)], "type string, t_rank int")
    classes = dims.dim(spark, fv.PREVALENCE_CLASSES, "class string, midpoint double")
    joined = (
        prevalence.join(F.broadcast(geo), "geography").join(F.broadcast(kind), "type").join(F.broadcast(classes), "class", "left")
    )
    case_reports = F.col("type") == fv.CASE_REPORTS_TYPE
    usable = joined.withColumn("p", F.when(case_reports, F.lit(fv.CASE_REPORTS_PREVALENCE)).otherwise(F.col("midpoint"))).withColumn(
        "class", F.when(case_reports, F.lit("case reports only")).otherwise(F.col("class"))).where("p IS NOT NULL")
    best = usable.groupBy(code).agg(F.min_by(
        F.struct("p", "class", "geography", "type"), F.struct("g_rank", "t_rank", position, "class")).alias("b"))
    return best.select(code, F.round(F.least(F.lit(1.0), F.sqrt(F.col("b.p") / 1e-3)), 4).alias("weight"), "b.class", "b.geography", "b.type")


def name_lookup(names: DataFrame) -> DataFrame:
    """(key, code) from (orphacode, name, pos): full names first, then unambiguous short forms.

    A short form drops trailing generic disease words and counts only when one code has it.
    """
    keyed = names.select("orphacode", "pos", norm_name(F.col("name")).alias("key")).where("key <> ''")
    full = keyed.groupBy("key").agg(F.min_by("orphacode", "pos").alias("code"))
    words = F.split("key", " ")
    generic = F.transform(words, lambda w: w.isin(*fv.GENERIC_SUFFIXES))
    cuts = F.filter(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.forall(
        F.slice(generic, k + 1, F.size(words)), lambda g: g))
    short = keyed.where(F.size(words) > 1).select("orphacode", F.explode(F.transform(
        cuts, lambda k: F.array_join(F.slice(words, 1, k), " "))).alias("key"))
    single = short.groupBy("key").agg(F.min("orphacode").alias("code"), F.max("orphacode").alias("_last")).where("code = _last").drop("_last")
    return full.unionByName(single.join(full.select("key"), "key", "left_anti"))


def link_conditions(conditions: DataFrame, names: DataFrame, priors: DataFrame) -> DataFrame:
    """Each condition_id with the prior of the first of its name parts that is known, or NULL."""
    pieces = lambda c: F.split(F.coalesce(F.col(c).cast("string"), F.lit("None")), r"\s*/\s*|\s*\(\s*|\)")
    parts = conditions.select("condition_id", F.posexplode(F.concat(pieces("name"), pieces("modern_equivalent"))).alias("pos", "part")).select(
        "condition_id", "pos", norm_name(F.col("part")).alias("key")).where(F.length("key") > 3)
    table = name_lookup(names)
    hits = parts.join(table, "key").groupBy("condition_id").agg(F.min_by("code", "pos").alias("orphacode"))
    linked = conditions.select("condition_id").join(hits, "condition_id", "left").join(priors, "orphacode", "left")
    return linked.select("condition_id", F.when(F.col("weight").isNotNull(), F.col("orphacode")).alias("orphacode"), "weight", "class", "geography", "type")


def condition_prior(conditions: DataFrame, prevalence: DataFrame, literature: DataFrame) -> DataFrame:
    """(condition_id, prior_weight): prevalence x regional weight; the latter for endemic modern names."""
    joined = conditions.join(prevalence.select("condition_id", F.col("weight").alias("_w")), "condition_id", "left").join(
        literature.select("evidence_key", "hits_all", "hits_region"), "evidence_key", "left")
    regional = F.when(
        (F.col("source") == "condition_kb_modern") & is_endemic_type(F.col("name")),
        regional_weight(F.col("hits_all"), F.col("hits_region")),
    ).otherwise(F.lit(1.0))
    return joined.select("condition_id", F.round(F.coalesce("_w", F.lit(1.0)) * regional, 4).alias("prior_weight"))


def evidence_papers(literature: DataFrame, conditions: DataFrame) -> DataFrame:
    """Literature rows whose key some condition uses."""
    return literature.join(conditions.select("evidence_key").distinct(), "evidence_key", "left_semi")


# --- free text ----------------------------------------------------------------------------------------
def match_free_text(queries: DataFrame, text: str, vocabulary: DataFrame, floor: float = 0.55) -> DataFrame:
    """Add ``matched``: exact or alias, else normalised, else the most similar key, else NULL.

    ``vocabulary`` is (term, df, aliases). Distinct phrases are matched once.
    """
    own = vocabulary.select(F.col("term").alias("key"), "term", F.lit(0).alias("_p"))
    alias = vocabulary.select(F.explode("aliases").alias("key"), "term", F.lit(1).alias("_p"))
    keys = own.unionByName(alias).groupBy("key").agg(F.min_by("term", F.struct("_p", "term")).alias("term"))

    plain = F.trim(fold_case(F.col(text)))
    normed = normalize_terms(queries.withColumn("_plain", plain), "_plain", "_norm").withColumn(
        "phrase", F.coalesce("_norm", "_plain")).drop("_norm", "_plain")
    phrases = normed.groupBy("phrase").agg(F.count(F.lit(1)).alias("uses"))
    exact = phrases.join(keys.withColumnRenamed("key", "phrase"), "phrase", "left")
    rest = exact.where("term IS NULL AND phrase <> ''").select("phrase")

    key_grams = char_grams(keys, "key", 2, 4, boundaries=True)
    weights = gram_weights(key_grams, keys.agg(F.count(F.lit(1)).alias("n")))
    near = similar_to_reference(
        unit_vectors(char_grams(rest, "phrase", 2, 4, boundaries=True), weights, sublinear=True),
        unit_vectors(key_grams, weights, sublinear=True), floor - 0.0005,
    ).select(F.col("query").alias("phrase"), F.col("term").alias("key"), "score")
    starts = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("phrase"))
    begun = rest.join(starts, "phrase").select("phrase", "key", F.lit(0.9).alias("score"))
    df = vocabulary.select("term", "df")
    best = (
        near.unionByName(begun).join(keys, "key").groupBy("phrase", "term").agg(F.max("score").alias("score"))
        .join(df, "term").groupBy("phrase").agg(
            F.min_by(F.struct("term", "score"), F.struct(-F.round("score", 9), -F.col("df"), F.col("term"))).alias("b"))
        .where(F.round("b.score", 3) >= floor).select("phrase", F.col("b.term").alias("near_term"))
    )
    found = exact.join(best, "phrase", "left").select("phrase", F.coalesce("term", "near_term").alias("matched"), "uses")
    return lookup(normed, found, "phrase", ["matched"], "uses", F.xxhash64(*queries.columns)).select(*queries.columns, "matched")


