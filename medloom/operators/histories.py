"""What is known of a patient over time, as long tables: timeline, recurrence by season, trends, dossier.

Nothing here gathers a patient: rows stay rows, so a patient or a condition with a third of all rows
costs what its rows cost. Readers sort the few rows of the patient they show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .longitudinal import last_n

DOSHAS = ("vata", "pitta", "kapha")


def timeline(labelled: DataFrame) -> DataFrame:
    """One row per encounter: (patient_id, encounter_id, date, ritu, status, triage_level, label, confirmed, shares).

    ``labelled`` comes from ``encounter_labels``. Shares of a stopped encounter are null: it was not assessed.
    """
    shares = [F.when(~F.col("stopped"), F.col(d)).alias(d) for d in DOSHAS]
    return labelled.select(
        "patient_id", F.col("id").alias("encounter_id"), F.to_date("created_at").alias("date"), "ritu", "status", "triage_level", "label", "confirmed", *shares)


def season_counts(labelled: DataFrame, least: int = 2) -> DataFrame:
    """(patient_id, label, ritu, n, episodes, seasonal) of labels with ``least`` episodes or more.

    Counts shrink in the tasks before the shuffle; a patient and label then have one row per season.
    """
    n = F.count(F.lit(1)).alias("n")
    seasons = labelled.where("label IS NOT NULL").groupBy("patient_id", "label", "ritu").agg(n)
    whole = seasons.groupBy("patient_id", "label").agg(
        F.sum("n").alias("episodes"), (F.max("n") >= 2).alias("seasonal"), F.collect_list(F.struct("ritu", "n")).alias("by_season")).where(F.col("episodes") >= least)
    return whole.select("patient_id", "label", "episodes", "seasonal", F.inline("by_season")).select("patient_id", "label", "ritu", "n", "episodes", "seasonal")


def _measures(df: DataFrame, user: str, series: str, at: Column, values: dict[str, Column], levels: dict[str, Column] | None = None) -> DataFrame:
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = [F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value"), text.alias("level")) for k, v in values.items()]
    rows += [F.struct(F.lit(k).alias("measure"), number.alias("value"), v.cast("string").alias("level")) for k, v in (levels or {}).items()]
    long = df.select(F.col(user).alias("user_id"), F.lit(series).alias("series"), at.alias("at"), F.explode(F.array(*rows)).alias("m"))
    return long.select("user_id", "series", "at", "m.*").where("value IS NOT NULL OR level IS NOT NULL")


def trends(encounters: DataFrame, daily: DataFrame, vitality: DataFrame) -> DataFrame:
    """(user_id, series, at, measure, value, level): all series in long form; a measure not taken has no row.

    ``encounters`` carry shares, ``ama`` and ``agni``; stopped ones are left out. ``daily`` carries a
    score and the map ``dosha_effect``; ``vitality`` is (user_id, at, score).
    """
    checks = _measures(encounters.where("NOT stopped"), "patient_id", "checkup", F.to_date("created_at"),
                       {d: F.col(d) for d in DOSHAS}, {k: F.col(k) for k in ("ama", "agni")})
    effects = {f"effect_{d}": F.try_element_at("dosha_effect", F.lit(d)) for d in DOSHAS}
    routine = _measures(daily, "user_id", "dinacharya", F.col("day"), {"score": F.col("score"), **effects})
    strength = _measures(vitality, "user_id", "ojas", F.to_date("at"), {"score": F.col("score")})
    return checks.unionByName(routine).unionByName(strength)


def dossier(visible: DataFrame, differential: DataFrame, conditions: DataFrame, symptoms: DataFrame, literature: DataFrame,
            papers: DataFrame, labelled: DataFrame, order: list[str], shown: int = 8, n_papers: int = 3) -> dict[str, DataFrame]:
    """All a reviewer sees of the visible cases, as tables that share keys.

    ``cases`` (encounter_id, patient_id, rank, condition_id), ``history`` and ``recurring`` by patient,
    ``references``, ``symptoms``, ``literature`` and the first ``n_papers`` ``papers`` by ``order``
    descending, each by condition. A condition's references stand once, not once a case, so the
    tables grow with the cases and the base and not with their product.
    """
    cases = visible.select(F.col("id").alias("encounter_id"), "patient_id").join(differential.where(F.col("rank") <= shown), "encounter_id")
    people = visible.select("patient_id").distinct()
    asked = conditions.join(cases.select("condition_id").distinct(), "condition_id", "left_semi")
    keys = asked.select("condition_id", "evidence_key")
    first = last_n(papers, ["evidence_key"], order, n_papers)
    return {
        "cases": cases,
        "history": timeline(labelled).join(people, "patient_id", "left_semi"),
        "recurring": season_counts(labelled.join(people, "patient_id", "left_semi")),
        "references": asked,
        "symptoms": symptoms.join(keys.select("condition_id"), "condition_id", "left_semi"),
        "literature": keys.join(literature, "evidence_key"),
        "papers": keys.join(first, "evidence_key"),
    }
