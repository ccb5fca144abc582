"""Encounter scoring over whole tables: triage, dosha shares, seasons, theta, ranked differential."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv
from ..functions.stats import dominant_dosha, softmax3
from ..functions.text import dosha_components
from .longitudinal import season_of
from .warehouse import base_rates


def answer_sets(answers: DataFrame) -> DataFrame:
    """(case_id, yes, no) from (case_id, symptom, present); sets are bounded by the vocabulary."""
    return answers.groupBy("case_id").agg(
        F.collect_set(F.when(F.col("present"), F.col("symptom"))).alias("yes"),
        F.collect_set(F.when(~F.col("present"), F.col("symptom"))).alias("no"))


# --- triage ---------------------------------------------------------------------------------------
def triage(cases: DataFrame, checklist: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, level, flags): a ticked item is an emergency, a reported trigger symptom urgent."""
    spark = cases.sparkSession
    ticked = checklist.where("yes").join(F.broadcast(dims.red_flags(spark)), "code").select("case_id", "code", F.lit("emergency").alias("level"), "advice")
    told = answers.where("present").join(F.broadcast(dims.symptom_triggers(spark)), "symptom").select("case_id", "code", F.lit("urgent").alias("level"), "advice")
    flags = ticked.unionByName(told).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("level", "code", "advice"))).alias("all"))
    stop = F.transform(F.filter("all", lambda f: f["level"] == "emergency"), lambda f: f["code"])
    kept = F.filter("all", lambda f: (f["level"] == "emergency") | ~F.array_contains(F.col("stop"), f["code"]))
    named = flags.withColumn("stop", stop).select("case_id", "stop", kept.alias("flags"))
    return cases.select("case_id").join(named, "case_id", "left").select(
        "case_id",
        F.when(F.size("stop") > 0, "emergency").when(F.size("flags") > 0, "urgent").otherwise("routine").alias("level"),
        F.coalesce("flags", F.array().cast("array<struct<level:string,code:string,advice:string>>")).alias("flags"))


# --- dosha shares -----------------------------------------------------------------------------------
def _shares(df: DataFrame, z: list[Column], extra: list[str]) -> DataFrame:
    v, p, k = softmax3(*z)
    out = df.select("case_id", *extra, v.alias("vata"), p.alias("pitta"), k.alias("kapha"))
    return out.withColumn("dominant", dominant_dosha(F.col("vata"), F.col("pitta"), F.col("kapha"), fv.DUAL_MARGIN))


def constitution(answers: DataFrame, coefficients: DataFrame, intercept: dict[str, float]) -> DataFrame:
    """(case_id, answered, vata, pitta, kapha, dominant) from questionnaire answers.

    ``coefficients`` is (question, option, vata, pitta, kapha): one row per option, a dimension.
    """
    known = answers.join(coefficients, ["question", "option"])
    sums = known.groupBy("case_id").agg(F.count(F.lit(1)).alias("answered"), *[F.sum(d).alias(f"z_{d}") for d in fv.DOSHAS])
    return _shares(sums, [F.col(f"z_{d}") + F.lit(float(intercept[d])) for d in fv.DOSHAS], ["answered"])


def examination_evidence(findings: DataFrame) -> DataFrame:
    """(case_id, items, vata, pitta, kapha) from (case_id, source, item)."""
    w = dims.evidence_weights(findings.sparkSession)
    wide = w.groupBy("source", "item").agg(*[F.sum(F.when(F.col("dosha") == d, F.col("weight")).otherwise(0.0)).alias(d) for d in fv.DOSHAS])
    met = findings.join(F.broadcast(wide), ["source", "item"])
    return met.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"), *[F.sum(d).alias(d) for d in fv.DOSHAS])


def imbalance(answers: DataFrame, llr: DataFrame, conditions: DataFrame, evidence: DataFrame | None = None, tempered: bool = True) -> DataFrame:
    """(case_id, used, vata, pitta, kapha, dominant): evidence tempered by sqrt of its count."""
    wide = llr.groupBy("symptom").agg(*[F.max(F.when(F.col("dosha") == d, F.col("llr"))).alias(d) for d in fv.DOSHAS])
    used = answers.where("present").join(wide, "symptom").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("used"), *[F.sum(d).alias(f"s_{d}") for d in fv.DOSHAS])
    if evidence is None:
        both = used.select("*", F.lit(0).alias("items"), *[F.lit(0.0).alias(d) for d in fv.DOSHAS])
    else:
        both = used.join(evidence, "case_id", "full")
    n = F.coalesce("used", F.lit(0)) + F.coalesce("items", F.lit(0))
    heat = F.greatest(F.lit(1.0), F.sqrt(n)) if tempered else F.lit(1.0)
    joined = both.join(F.broadcast(base_rates(conditions))).withColumn("used", F.coalesce("used", F.lit(0)))
    start = lambda d: F.when(F.col(f"base_{d}") > 0, F.log(f"base_{d}")).otherwise(F.lit(float("-inf")))
    z = [start(d) + (F.coalesce(f"s_{d}", F.lit(0.0)) + F.coalesce(d, F.lit(0.0))) / heat for d in fv.DOSHAS]
    named = joined.select("case_id", "used", *[x.alias(f"z_{d}") for x, d in zip(z, fv.DOSHAS)])
    return _shares(named, [F.col(f"z_{d}") for d in fv.DOSHAS], ["used"])


def ama_level(cases: DataFrame, answers: DataFrame, tongue: DataFrame | None = None) -> DataFrame:
    """(case_id, level, signs). A coated tongue counts once as symptom and once as examined."""
    said = answers.where(F.col("present") & F.col("symptom").isin(*fv.AMA_SIGNS)).select("case_id", F.col("symptom").alias("sign"))
    if tongue is not None:
        said = said.unionByName(tongue.where("item = 'coated_white'").select("case_id", F.lit(fv.AMA_EXAMINED).alias("sign")))
    signs = said.groupBy("case_id").agg(F.sort_array(F.collect_set("sign")).alias("signs"))
    n = F.coalesce(F.size("signs"), F.lit(0))
    return cases.select("case_id").join(signs, "case_id", "left").select(
        "case_id", F.when(n >= 3, "high").when(n == 2, "moderate").otherwise("low").alias("level"),
        F.coalesce("signs", F.array().cast("array<string>")).alias("signs"))


def season_weights(day: Column, habitat: Column) -> list[Column]:
    """Season and place weight of each dosha: expressions, no join."""
    season = season_of(day)
    out = []
    for d in fv.DOSHAS:
        chain = F
        for name, *_ in fv.SEASONS:
            chain = chain.when(season == name, F.lit(fv.STATE_WEIGHTS[fv.DOSHA_CYCLE[d].get(name, "neutral")]))
        places = [h for h, doshas in fv.HABITAT_DOSHAS.items() if d in doshas]
        out.append((chain.otherwise(F.lit(1.0)) * F.when(habitat.isin(*places), F.lit(fv.HABITAT_FACTOR)).otherwise(1.0)).alias(f"{d}_season"))
    return out


# --- knowledge base for the differential ----------------------------------------------------------------
def theta_cells(bridge: DataFrame, terms: DataFrame, feedback: DataFrame | None = None, m: float = fv.FEEDBACK_PSEUDO_CASES) -> DataFrame:
    """Sparse (condition_id, symptom, theta): listed or updated cells; others are background."""
    listed = bridge.select("condition_id", "symptom", F.lit(fv.THETA_LISTED).alias("listed"))
    if feedback is None:
        return listed.withColumnRenamed("listed", "theta")
    joined = listed.join(feedback, ["condition_id", "symptom"], "full").join(terms.select("symptom", "background"), "symptom")
    start = F.coalesce("listed", "background")
    theta = F.when(F.col("asked").isNotNull(), (m * start + F.col("present")) / (m + F.col("asked"))).otherwise(start)
    return joined.select("condition_id", "symptom", F.least(F.greatest(theta, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("theta"))


def feedback_counts(cases: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Additive statistics of confirmed cases: (condition_id, n) and (condition_id, symptom, present, asked)."""
    per_condition = cases.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"))
    cells = answers.join(cases.select("case_id", "condition_id"), "case_id").groupBy("condition_id", "symptom").agg(
        F.sum(F.col("present").cast("long")).alias("present"), F.count(F.lit(1)).alias("asked"))
    return per_condition, cells


def model_conditions(conditions: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Conditions without conflicts, with log prior and dosha mix, ready for the scorer."""
    kept = conditions.where("NOT profile_conflict")
    if feedback is not None:
        kept = kept.join(feedback, "condition_id", "left").withColumn("_count", 1 + F.coalesce("n", F.lit(0)))
    else:
        kept = kept.withColumn("_count", F.lit(1))
    total = kept.agg(F.sum("_count").alias("_total"))
    parts = dosha_components(F.col("dosha"))
    mix = [F.when(F.array_contains(parts, d), 1.0 / F.size(parts)).otherwise(0.0).alias(d) for d in fv.DOSHAS]
    return kept.join(F.broadcast(total)).select(
        "condition_id", F.lower(F.trim("name")).alias("name"), (F.log(F.col("_count") / F.col("_total")) + F.log("prior_weight")).alias("log_prior"),
        *mix, "age_low", "age_high", "female_weight", "male_weight")


# --- rule tables ---------------------------------------------------------------------------------------
def derived_signs(answers: DataFrame) -> DataFrame:
    """(case_id, kind, entity, side, score, matched): subdoshas, tissues and channels with signs."""
    table = F.broadcast(dims.sign_table(answers.sparkSession))
    met = answers.where("present").select("case_id", F.col("symptom").alias("sign")).join(table, "sign")
    return met.groupBy("case_id", "kind", "entity", "side").agg(
        F.count(F.lit(1)).alias("score"), F.sort_array(F.collect_set("sign")).alias("matched"))


def tissue_states(cases: DataFrame, answers: DataFrame, bmi: str | None = None) -> DataFrame:
    """One column per tissue: normal, kshaya, vriddhi or mixed; body-mass index counts for two."""
    signs = {}  # each sign's sides as bits: two a tissue, so that a case is one number
    for i, (_, _, low, high) in enumerate(fv.DHATUS):
        for side, names in enumerate((low, high)):
            for sign in names:
                signs[sign] = signs.get(sign, 0) | 1 << (2 * i + side)
    table = F.broadcast(dims.dim(answers.sparkSession, sorted(signs.items()), "symptom string, sides int"))
    met = answers.where("present").join(table, "symptom").groupBy("case_id").agg(F.bit_or("sides").alias("_sides"))
    joined = cases.join(met, "case_id", "left")
    sides = F.coalesce("_sides", F.lit(0))
    b = F.col(bmi) if bmi else F.lit(None).cast("double")
    states = []
    for i, (name, *_) in enumerate(fv.DHATUS):
        low = sides.bitwiseAND(F.lit(1 << 2 * i)) > 0
        high = sides.bitwiseAND(F.lit(2 << 2 * i)) > 0
        if name in ("mamsa", "meda"):
            low = low | F.coalesce(b < fv.BMI_UNDERWEIGHT, F.lit(False))
        if name == "meda":
            high = high | F.coalesce(b >= fv.BMI_OBESE, F.lit(False))
        states.append(F.when(low & high, "mixed").when(low, "kshaya").when(high, "vriddhi").otherwise("normal").alias(name))
    return joined.select("case_id", *states)


def life_stage(age: Column) -> Column:
    """struct(stage, dosha, note); NULL outside the bands."""
    chain = F
    for lo, hi, stage, dosha, note in fv.LIFE_STAGES:
        chain = chain.when((age >= lo) & (age < hi), F.struct(F.lit(stage).alias("stage"), F.lit(dosha).alias("dosha"), F.lit(note).alias("note")))
    return chain


def clock_dosha(hour: Column) -> Column:
    chain = F
    for start, end, dosha in fv.DOSHA_CLOCK:
        inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        chain = chain.when(inside, F.lit(dosha))
    return chain


def guidance(season: Column, dominant: Column) -> list[Column]:
    """Season tips and balancing habits as arrays."""
    s = F
    for name, *_ in fv.SEASONS:
        s = s.when(season == name, F.array(*[F.lit(t) for n, t in fv.SEASON_GUIDANCE if n == name]))
    tips = lambda d: F.array(*[F.lit(t) for n, t in fv.DOSHA_GUIDANCE if n == d])
    none = F.array().cast("array<string>")
    parts = F.split(F.when(dominant != "tridosha", dominant), "-")
    each = F.transform(parts, lambda p: F.when(p == "vata", tips("vata")).when(p == "pitta", tips("pitta")).when(p == "kapha", tips("kapha")).otherwise(none))
    return [F.coalesce(s, none).alias("season_tips"), F.coalesce(F.flatten(each), none).alias("balance_tips")]
