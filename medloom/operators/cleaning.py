"""Projections and cleaning: typed cohorts, pseudonyms, prose parsing, small scalar rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import dosha_code, fold_case, pseudonym, snake
from .skew import expand_copies


# --- typed cohort ------------------------------------------------------------------------------
def clean_intake(df: DataFrame, outcome: str = "Diabetes Diagnosis", family: str = "Family History of Diabetes") -> DataFrame:
    """Typed intake records; preference tokens stay an array (widen with ``preference_flags``)."""
    word = lambda name: F.trim(fold_case(F.col(f"`{name}`")))
    number = lambda name, kind: F.col(f"`{name}`").cast("string").try_cast("double").cast(kind)
    known = word(family)
    answer = word(outcome)
    tokens = F.split(F.coalesce(fold_case(F.col("`Food Preferences`")), F.lit("")), r",\s*")
    filled = F.filter(F.transform(tokens, F.trim), lambda t: t != "")
    return df.select(
        "record_id",
        "patient_key",
        number("Age", "long").alias("age"),
        word("Gender").alias("gender"),
        word("Prakriti").alias("prakriti_raw"),
        dosha_code(word("Prakriti")).alias("dosha"),
        word("Diet").alias("diet"),
        word("Meal Timing").alias("meal_timing"),
        F.coalesce(fold_case(F.col("Exercise")) == "yes", F.lit(False)).alias("exercise"),
        number("Sleep Hours/Night", "double").alias("sleep_hours"),
        word("Sleep Quality").alias("sleep_quality"),
        word("Daily Routine").alias("daily_routine"),
        number("Stress Level", "long").alias("stress_level"),
        F.when(known.isNull() | known.isin(*fv.UNKNOWN_ANSWERS), F.when(known.isNotNull(), F.lit("unknown")))
        .otherwise(known).alias("family_history"),
        F.when(answer == "yes", 1).when(answer == "no", 0).cast("long").alias("diabetes"),
        filled.alias("prefs"),
        F.size(filled).cast("long").alias("n_food_prefs"),
    )


def preference_flags(df: DataFrame, column: str = "prefs", tokens: list[str] | None = None, limit: int = 200) -> DataFrame:
    """One boolean column per token. Unlisted tokens are read from the data, at most ``limit``."""
    if tokens is None:
        seen = df.select(F.explode(column).alias("t")).distinct().limit(limit + 1).collect()
        if len(seen) > limit:
            raise ValueError(f"more than {limit} tokens in {column}; keep the array or pass tokens")
        tokens = sorted(r["t"] for r in seen)
    flags = [
        F.array_contains(column, t).alias("pref_" + re.sub("[^a-z]+", "_", t)) for t in tokens
    ]
    return df.select("*", *flags)


def clean_assessment(df: DataFrame, row_id: str, label: str = "dosha") -> DataFrame:
    """Snake-case headers, stable id first, canonical label."""
    renamed = df.select(F.col(f"`{row_id}`").alias("assessment_id"),
                        *[F.col(f"`{c}`").alias(snake(c)) for c in df.columns if c != row_id])
    return renamed.withColumn(label, dosha_code(F.col(label)))


# --- identity -----------------------------------------------------------------------------------
def scrub(df: DataFrame, identity: list[str], salt: str, key_from: list[str], ascii_only: bool = False) -> DataFrame:
    """Drop ``identity`` columns; add ``patient_key`` (may repeat) and ``record_id`` (unique).

    Copies of a row are counted first and numbered when written out again, so the id depends on
    content and occurrence only, and a large group of copies is spread over many tasks.
    """
    text = lambda cols: F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in cols])
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    rows = expand_copies(counted, "_copies", "_number")
    full = F.concat_ws("|", text(df.columns), F.col("_number").cast("string"))
    return rows.select(
        pseudonym(full, salt, 20, ascii_only).alias("record_id"),
        pseudonym(text(key_from), salt, 16, ascii_only).alias("patient_key"),
        *[c for c in df.columns if c not in identity],
    )


# --- prose demographics ----------------------------------------------------------------------------
def age_range(text: Column) -> Column:
    """struct(low, high) of ages a phrase describes; the union of all age words it holds."""
    t = fold_case(text)
    span = r"(\d{1,2})\s*[-–to]+\s*(\d{1,3})"
    low, high = F.regexp_extract(t, span, 1), F.regexp_extract(t, span, 2)
    plus = F.regexp_extract(t, r"(\d{1,2})\s*\+", 1)
    words = F.array_compact(F.array(*[F.when(t.rlike(p), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for p, lo, hi in fv.AGE_WORDS]))
    pair = lambda a, b: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"))
    everyone = pair(F.lit(0), F.lit(120))
    union = lambda w: F.when(F.size(w) > 0, pair(F.array_min(w["lo"]), F.array_max(w["hi"]))).otherwise(everyone)
    return (
        F.when(text.isNull() | t.rlike("any age|all age"), everyone)
        .when(low != "", pair(low, high))
        .when(plus != "", pair(plus, F.lit(120)))
        .otherwise(F.element_at(F.transform(F.array(words), union), 1))  # each word is sought once
    )


def sex_weight(gender: Column, age_text: Column | None = None) -> Column:
    """struct(female, male); 0.02 for the other sex only on exclusive wording."""
    text = fold_case(F.concat_ws(" ", gender, age_text) if age_text is not None else F.coalesce(gender, F.lit("")))
    female, male = text.rlike(fv.FEMALE_WORDS), text.rlike(fv.MALE_WORDS)
    pair = lambda f, m: F.struct(F.lit(f).cast("double").alias("female"), F.lit(m).cast("double").alias("male"))
    leaning = text.rlike(fv.LEANING_WORDS) | text.contains("any")
    return (
        F.when(female & male & text.rlike("females? only|exclusively"), pair(1.0, 0.02))
        .when(female & male & text.rlike("(?<!fe)males? only"), pair(0.02, 1.0))
        .when(female & male, pair(1.0, 1.0))
        .when(female & leaning, pair(1.0, 0.6))
        .when(female, pair(1.0, 0.02))
        .when(male & leaning, pair(0.6, 1.0))
        .when(male, pair(0.02, 1.0))
        .otherwise(pair(1.0, 1.0))
    )


def age_fit(age: Column, low: Column, high: Column) -> Column:
    gap = F.greatest(low - age, age - high, F.lit(0))
    return F.when(age.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.15), 1.0 - gap / 20.0))


# --- literature and place ----------------------------------------------------------------------------
def query_key(name: Column) -> Column:
    """Search key: before the first bracket, first '/' part that is not only a qualifier."""
    head = F.element_at(F.split(name, r"\s*\("), 1)
    parts = F.filter(F.transform(F.split(head, "/"), F.trim), lambda p: p != "")
    useful = F.filter(parts, lambda p: ~fold_case(p).isin(*fv.KEY_QUALIFIERS))
    return F.trim(F.coalesce(F.get(useful, F.lit(0)), F.get(parts, F.lit(0)), head))


def condition_query_key(source: Column, name: Column, modern: Column) -> Column:
    return query_key(F.when(source == "condition_kb_modern", name).otherwise(modern))


def is_endemic_type(name: Column) -> Column:
    return name.rlike(fv.ENDEMIC_PATTERN)


def regional_weight(hits_all: Column, hits_region: Column, min_hits: int = fv.REGIONAL_MIN_HITS) -> Column:
    share = hits_region / hits_all
    tempered = F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.sqrt(share / fv.REGIONAL_BASELINE_SHARE))), 4)
    return F.when(hits_all.isNull() | (hits_all < min_hits), F.lit(1.0)).otherwise(tempered)


def location_cell(lat: Column, lon: Column) -> Column:
    """Coarse cell name, 0.1 degrees; ties go to the even digit."""

    def part(v: Column) -> Column:
        shown = F.format_string("%.1f", F.bround(v, 1))
        return F.when((v < 0) & (shown == "0.0"), F.lit("-0.0")).otherwise(shown)

    return F.concat_ws(",", part(lat), part(lon))


def age_on(dob: Column, on: Column) -> Column:
    month_day = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    return F.year(on) - F.year(dob) - (month_day(on) < month_day(dob)).cast("int")


def profile_signals(answers: DataFrame, user: str, module: str, question: str, option: str, at: str, number: str) -> DataFrame:
    """Latest module answers carried into an encounter: stool, urine, digestion and BMI.

    ``max_by`` keeps one row per (user, question) already before the shuffle.
    """
    wanted = (F.col(module) == "agni_mala") & F.col(question).isin("stool", "urine", "agni") | (
        (F.col(module) == "dashavidha") & F.col(question).isin("height_cm", "weight_kg"))
    pick = lambda m, q, v: F.max_by(v, F.when((F.col(module) == m) & (F.col(question) == q), F.col(at)))
    latest = answers.where(wanted).groupBy(user).agg(
        pick("agni_mala", "stool", F.col(option)).alias("stool"),
        pick("agni_mala", "urine", F.col(option)).alias("urine"),
        pick("agni_mala", "agni", F.col(option)).alias("agni_answer"),
        pick("dashavidha", "height_cm", F.col(number)).alias("height"),
        pick("dashavidha", "weight_kg", F.col(number)).alias("weight"),
    )
    agni = F
    for answer, name in fv.MODULE_TO_ENCOUNTER_AGNI:
        agni = agni.when(F.col("agni_answer") == answer, F.lit(name))
    return latest.select(
        user,
        F.when(F.col("stool") != "normal", F.col("stool")).alias("mala"),
        F.when(F.col("urine") != "normal", F.col("urine")).alias("mutra"),
        agni.alias("agni"),
        F.round(F.col("weight") / F.pow(F.col("height") / 100, 2), 1).alias("bmi"),
    )
