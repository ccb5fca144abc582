"""Questionnaire modules scored over long answer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv


def validate(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (user_id, module, question, option, number) into accepted and quarantined rows."""
    options = F.broadcast(dims.option_signals(answers.sparkSession).select("module", "question", "option", F.lit(True).alias("_known")))
    joined = answers.join(options, ["module", "question", "option"], "left")
    in_range = F.lit(False)
    for module, question, low, high in fv.NUMBER_QUESTIONS:
        in_range = in_range | ((F.col("module") == module) & (F.col("question") == question) & F.col("number").between(low, high))
    ok = F.coalesce(F.col("_known") | in_range, in_range, F.lit(False))
    empty = F.col("number").isNull() & (F.col("option").isNull() | (F.col("option") == ""))
    marked = joined.where(~empty).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return marked.where("_ok").drop("_ok", "_known"), marked.where("NOT _ok").drop("_ok", "_known")


def score_modules(accepted: DataFrame) -> DataFrame:
    """One row per (user_id, module): signals, shares, strength, body-mass class, cycle pattern.

    Expects one answer per question; take the latest first.
    """
    spark = accepted.sparkSession
    names = [*fv.DOSHAS, *fv.GUNAS]
    joined = accepted.join(F.broadcast(dims.option_signals(spark)), ["module", "question", "option"], "left").join(
        F.broadcast(dims.ojas_points(spark).withColumn("module", F.lit("ojas_bala"))), ["module", "question", "option"], "left")
    pick = lambda q: F.max(F.when(F.col("question") == q, F.col("option")))
    value = lambda q: F.max(F.when(F.col("question") == q, F.col("number")))
    sums = joined.groupBy("user_id", "module").agg(
        F.count(F.lit(1)).alias("answered"), *[F.sum(F.coalesce(n, F.lit(0.0))).alias(n) for n in names],
        F.sum("points").alias("points"), F.sum("best").alias("best"), value("height_cm").alias("_h"), value("weight_kg").alias("_w"),
        pick("agni").alias("_agni"), pick("koshtha").alias("_koshtha"), pick("aharashakti").alias("_aharashakti"))
    ojas = F.when((F.col("module") == "ojas_bala") & (F.col("best") > 0), F.bround(100.0 * F.col("points") / F.col("best"), 0).cast("long"))
    bmi = F.round(F.col("_w") / F.pow(F.col("_h") / 100, 2), 1)
    guna = F.col("sattva") + F.col("rajas") + F.col("tamas")
    share = lambda g: F.when(F.col("module") == "manas_prakriti", F.when(guna > 0, F.round(F.col(g) / guna, 3)).otherwise(F.lit(0.333)))
    top3 = lambda cols: F.when(F.col(cols[0]) >= F.greatest(cols[1], cols[2]), F.lit(cols[0])).when(F.col(cols[1]) >= F.col(cols[2]), F.lit(cols[1])).otherwise(F.lit(cols[2]))
    any_signal = F.greatest(*fv.DOSHAS) > 0

    def named(question: str):
        chain = F
        for q, option, name in fv.DIGESTION_NAMES:
            if q == question:
                chain = chain.when((F.col("module") == "agni_mala") & (F.col(f"_{q}") == option), F.lit(name))
        return chain.alias(question)

    scored = sums.withColumn("ojas_score", ojas).withColumn("bmi", bmi)
    return scored.select(
        "user_id", "module", "answered", *fv.DOSHAS, *[share(g).alias(f"{g}_share") for g in fv.GUNAS],
        F.when(F.col("module") == "manas_prakriti", top3(fv.GUNAS)).alias("dominant_guna"),
        "ojas_score", F.when(F.col("ojas_score") >= 70, "pravara").when(F.col("ojas_score") >= 40, "madhyama").when(F.col("ojas_score").isNotNull(), "avara").alias("bala"),
        "bmi", F.when(F.col("bmi") < fv.BMI_UNDERWEIGHT, "underweight").when(F.col("bmi") < fv.BMI_OVERWEIGHT, "normal").when(
            F.col("bmi") < fv.BMI_OBESE, "overweight").when(F.col("bmi").isNotNull(), "obese").alias("pramana"),
        F.when(F.col("module") == "artava", F.when(any_signal, top3(fv.DOSHAS)).otherwise("balanced")).alias("pattern"),
        named("agni"), named("koshtha"), named("aharashakti"))
