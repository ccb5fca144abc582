"""Learning loop: candidate against active model on the newest cases, promotion and version rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from . import bayes
from . import scoring as sc
from .privacy import time_split
from .risk import rank_metrics


def holdout_ranks(cases: DataFrame, conditions: DataFrame, bridge: DataFrame, terms: DataFrame, feedback: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """(case_id, rank) of the confirmed diagnosis, one rank per disease name.

    ``cases``: case_id, condition_id, yes, no, age, sex, vikriti.
    """
    counts, cells = feedback or (None, None)
    model = sc.model_conditions(conditions, counts)
    names = model.select(F.col("condition_id"), F.col("name").alias("_true"))
    total = model.select("name").distinct().count()
    base = bayes.knowledge_base(model, sc.theta_cells(bridge, terms, cells), terms)
    ranked, _ = bayes.rank_long(cases, base, top=total)
    wanted = cases.select("case_id", "condition_id").join(names, "condition_id", "left")
    joined = wanted.join(ranked.select("case_id", F.col("name").alias("_true"), "place"), ["case_id", "_true"], "left")
    return joined.select("case_id", F.coalesce("place", F.lit(total)).cast("int").alias("rank"))


def gate(cases: DataFrame, answers: DataFrame, conditions: DataFrame, bridge: DataFrame, terms: DataFrame, active_cases: DataFrame | None = None,
         minimum: int = fv.MIN_LEARNING_CASES) -> DataFrame:
    """One row: both models on the newest fifth, and whether the candidate is promoted.

    ``cases``: case_id, condition_id, created_at, age, sex of consented confirmed cases. The candidate
    learns from the older four fifths; ``active_cases`` (case_id) is what the active model learned from.
    """
    available = cases.count()
    if available < minimum:
        return cases.sparkSession.range(1).select(F.lit(False).alias("promoted"), F.lit(available).alias("available"),
                                                  F.lit(None).cast("double").alias("candidate_top5"), F.lit(None).cast("double").alias("active_top5"))
    split = time_split(cases, ["created_at", "case_id"])
    train = split.where("part = 'train'")
    newest = split.where("part = 'holdout'").join(sc.answer_sets(answers), "case_id").withColumn("age", F.col("age").cast("double"))
    learned = sc.feedback_counts(train, answers)
    current = None
    if active_cases is not None:
        current = sc.feedback_counts(train.join(active_cases, "case_id", "left_semi"), answers)
    top5 = lambda fb, name: rank_metrics(holdout_ranks(newest, conditions, bridge, terms, fb), "rank").select(F.col("top5").alias(name))
    both = top5(learned, "candidate_top5").crossJoin(top5(current, "active_top5"))
    return both.select((F.col("candidate_top5") >= F.col("active_top5")).alias("promoted"), F.lit(available).alias("available"), "candidate_top5", "active_top5")


def version_row(decision: DataFrame, version: str, pack_version: str) -> DataFrame:
    """The row to append to the version table when the candidate is promoted."""
    return decision.where("promoted").select(
        F.lit(version).alias("version"), F.lit(pack_version).alias("pack_version"), F.col("available").alias("n_cases"),
        F.to_json(F.struct("candidate_top5", "active_top5")).alias("metrics"), F.lit(True).alias("active"))
