"""Dated rows: latest per key, weekly windows, streaks, timelines, daily logs and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv


# --- latest and last-n ----------------------------------------------------------------------------
def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. ``max_by`` aggregates before the shuffle, so hot keys stay small."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def consents_in_force(consents: DataFrame) -> DataFrame:
    """(user_id, purpose, granted): the last entry decides."""
    return consents.groupBy("user_id", "purpose").agg(F.max_by("granted", "id").alias("granted"))


def consented(consents: DataFrame, purpose: str) -> DataFrame:
    """(user_id) with ``purpose`` granted now."""
    only = consents.where(F.col("purpose") == purpose)
    return consents_in_force(only).where("granted").select("user_id")


def latest_usable_encounter(encounters: DataFrame) -> DataFrame:
    return latest(encounters.where("NOT stopped"), ["patient_id"], ["created_at", "id"])


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int = fv.HISTORY_LIMIT) -> DataFrame:
    """Newest ``n`` rows per key; ranks above n are dropped per task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def upsert_daily(entries: DataFrame, backfill: int = fv.BACKFILL_DAYS) -> DataFrame:
    """One row per (user, day): the last write wins; a write for a day too old or ahead of it is refused."""
    written = F.to_date("written_at")
    inside = (F.col("day") <= written) & (F.col("day") >= F.date_sub(written, backfill))
    return latest(entries.where(inside), ["user_id", "day"], ["written_at", "id"])


# --- windows over days --------------------------------------------------------------------------------
def week_window(logs: DataFrame, today: Column) -> DataFrame:
    return logs.where(F.col("day") > F.date_sub(today, 7))


def streaks(logs: DataFrame, today: Column) -> DataFrame:
    """(user_id, streak): consecutive days ending today. One row per user and day is kept first,
    so a window holds at most the days of the calendar."""
    days = logs.where(F.col("day") <= today).select("user_id", "day").distinct()
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("day").desc()))
    run = days.withColumn("_n", back).withColumn("_gap", F.datediff(today, F.col("day")) - F.col("_n") + 1)
    return run.groupBy("user_id").agg(F.count_if(F.col("_gap") == 0).alias("streak"))


def encounter_labels(encounters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Each encounter with its label: last confirmed diagnosis, else the top-ranked condition."""
    confirmed = (
        reviews.where(F.col("decision").isin(*fv.LEARNING_DECISIONS))
        .groupBy(F.col("encounter_id").alias("id"))
        .agg(F.max_by("condition_id", F.struct("created_at", "id")).alias("_confirmed"), F.lit(True).alias("confirmed"))
    )
    joined = encounters.join(confirmed, "id", "left")
    label = F.when(F.col("confirmed"), F.col("_confirmed")).otherwise(F.col("top_condition"))
    return joined.withColumn("label", label).withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).drop("_confirmed")


def recurring(labelled: DataFrame, min_episodes: int = 2) -> DataFrame:
    """(patient_id, label, episodes, seasonal): seasonal when one season holds two or more."""
    per_season = labelled.where("label IS NOT NULL").groupBy("patient_id", "label", "ritu").agg(F.count(F.lit(1)).alias("n"))
    return per_season.groupBy("patient_id", "label").agg(
        F.sum("n").alias("episodes"), (F.max("n") >= 2).alias("seasonal")
    ).where(F.col("episodes") >= min_episodes)


def first_last_trend(df: DataFrame, key: str, order: list[str], measures: list[str], digits: int = 3) -> DataFrame:
    """Change from the first to the last row of each key with at least two rows."""
    at = F.struct(*order)
    rows = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min_by(m, at).alias(f"_a_{m}") for m in measures], *[F.max_by(m, at).alias(f"_z_{m}") for m in measures],
    ).where("_n >= 2")
    return rows.select(key, *[F.round(F.col(f"_z_{m}") - F.col(f"_a_{m}"), digits).alias(f"{m}_trend") for m in measures])


def trend_series(encounters: DataFrame, daily: DataFrame) -> DataFrame:
    """(user_id, series, at, value): long form, so no user becomes one wide row."""
    checks = encounters.where("NOT stopped").select(
        F.col("patient_id").alias("user_id"), F.lit("checkup").alias("series"), F.to_date("created_at").alias("at"),
        F.col("vata").cast("double").alias("value"))
    scores = daily.select("user_id", F.lit("routine").alias("series"), F.col("day").alias("at"), F.col("score").cast("double").alias("value"))
    return checks.unionByName(scores)


# --- calendar ---------------------------------------------------------------------------------------------
def season_of(day: Column) -> Column:
    """Season by month and day; early January still belongs to the last season."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    chain = F
    for name, month, start, _ in reversed(fv.SEASONS):
        chain = chain.when(md >= month * 100 + start, F.lit(name))
    return F.when(day.isNotNull(), chain.otherwise(F.lit(fv.SEASONS[-1][0])))


def upcoming_seasons(df: DataFrame, day: str, n: int = 2) -> DataFrame:
    """The next ``n`` season starts of every row with their distance in days."""
    starts = F.array(*[
        F.struct(F.make_date(F.year(day) + y, F.lit(m), F.lit(d)).alias("starts"), F.lit(name).alias("season"))
        for y in (0, 1) for name, m, d, _ in fv.SEASONS
    ])
    ahead = F.slice(F.filter(starts, lambda x: x["starts"] > F.col(day)), 1, n)
    return df.select("*", F.explode(ahead).alias("_s")).select(
        *df.columns, F.col("_s.season").alias("season"), F.col("_s.starts").alias("starts"),
        F.datediff(F.col("_s.starts"), F.col(day)).alias("days_away"))


# --- daily routine and meals ---------------------------------------------------------------------------------
def routine_score(items: Column) -> Column:
    """Points of the items marked true in a map; unknown items count nothing."""
    total = F.lit(0)
    for item, points in fv.ROUTINE_POINTS:
        total = total + F.when(F.coalesce(F.try_element_at(items, F.lit(item)), F.lit(False)), F.lit(points)).otherwise(0)
    return total


def meal_flags(meals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, meal, rule_id, message): incompatible combinations.

    ``meals`` is long: (keys, meal, food). A rule holds when every tag it needs is on the plate.
    """
    spark = meals.sparkSession
    tags = meals.join(F.broadcast(dims.food_tags(spark)), "food").select(*keys, "meal", "tag").distinct()
    met = tags.join(F.broadcast(dims.meal_rules(spark)), "tag").where(
        F.col("only_meal").isNull() | (F.col("only_meal") == F.col("meal")))
    return (
        met.groupBy(*keys, "meal", "rule_id", "message", "needed").agg(F.count(F.lit(1)).alias("n"))
        .where("n = needed").select(*keys, "meal", "rule_id", "message")
    )


def taste_totals(meals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, six taste counts, dosha effects, missing): one aggregate."""
    spark = meals.sparkSession
    tasted = meals.join(F.broadcast(dims.food_tastes(spark)), "food", "left")
    names = [t for t, *_ in fv.TASTE_EFFECTS]
    counts = tasted.groupBy(*keys).agg(*[F.count_if(F.col("taste") == t).alias(t) for t in names])
    effects = [
        sum([F.col(t) * e[i] for t, *e in fv.TASTE_EFFECTS], F.lit(0)).alias(f"{d}_effect") for i, d in enumerate(fv.DOSHAS)
    ]
    missing = F.array_compact(F.array(*[F.when(F.col(t) == 0, F.lit(t)) for t in names])).alias("missing_tastes")
    return counts.select(*keys, *names, *effects, missing)


# --- profile --------------------------------------------------------------------------------------------------
def weekly_profile(daily: DataFrame, meals: DataFrame, today: Column) -> DataFrame:
    """(user_id, days, average score, streak, tastes, effects): last seven days per user."""
    week = week_window(daily, today)
    scores = week.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("days"), F.bround(F.avg("score"), 0).cast("long").alias("average_score"))
    diet = taste_totals(week_window(meals, today), ["user_id"])
    return scores.join(streaks(daily, today), "user_id", "left").join(diet.drop("missing_tastes"), "user_id", "left")


def completeness(df: DataFrame, sex: str) -> DataFrame:
    """Add ``completeness``: weighted share of finished parts; the female-only part is left out
    for everyone else. One flag column per part."""
    female = F.coalesce(F.col(sex) == "female", F.lit(False))
    got, total = F.lit(0), F.lit(0)
    for part, weight in fv.COMPLETENESS_WEIGHTS:
        applies = female if part == "artava" else F.lit(True)
        total = total + F.when(applies, weight).otherwise(0)
        got = got + F.when(applies & F.coalesce(F.col(part), F.lit(False)), weight).otherwise(0)
    return df.withColumn("completeness", F.bround(100 * got / total, 0).cast("long"))


def recommendations(season: Column, days_away: Column, focus: Column, average: Column, incompatible: Column,
                    strength: Column, ama: Column, shown: int = 6) -> Column:
    """First ``shown`` general pointers that apply, in their fixed order."""
    builds = F
    for name, *_ in fv.SEASONS:
        states = {d: fv.DOSHA_CYCLE[d].get(name, "neutral") for d in fv.DOSHAS}
        worse = [d for d in fv.DOSHAS if states[d] == "prakopa"] or [d for d in fv.DOSHAS if states[d] == "chaya"]
        if worse:
            builds = builds.when(season == name, F.lit(", ".join(worse)))
    near = F.when(
        (days_away <= 30) & builds.isNotNull(),
        F.concat(F.initcap(season), F.lit(" begins in "), days_away.cast("string"), F.lit(" days and builds "), builds,
                 F.lit(" - start adjusting diet and routine now (Ritu sandhi).")))
    first_tip = {}
    for dosha, tip in fv.DOSHA_GUIDANCE:
        first_tip.setdefault(dosha, tip)
    parts = F.split(F.coalesce(focus, F.lit("")), "-")
    tip_of = lambda d: F.when(d == "vata", F.lit(first_tip["vata"])).when(d == "pitta", F.lit(first_tip["pitta"])).when(
        d == "kapha", F.lit(first_tip["kapha"]))
    tips = F.concat(
        F.array(near),
        F.transform(parts, tip_of),
        F.array(
            F.when(average < 50, F.lit(fv.ADVICE_LOW_ROUTINE)),
            F.when(incompatible, F.lit(fv.ADVICE_INCOMPATIBLE)),
            F.when(strength == "avara", F.lit(fv.ADVICE_LOW_OJAS)),
            F.when(ama == "high", F.lit(fv.ADVICE_AMA)),
        ),
    )
    return F.slice(F.array_compact(tips), 1, shown)
