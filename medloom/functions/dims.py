"""Rule tables as small dimension DataFrames (fixed size, safe to broadcast)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return f"{value!r}D" if isinstance(value, float) else str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def dim(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """An inline table: a local relation in the plan, no Python worker and no job."""
    columns = [part.split() for part in schema.split(",")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in columns)
    frame = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return frame.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def dosha_dimension(spark: SparkSession) -> DataFrame:
    rows = []
    for order, code in enumerate(fv.DOSHA_CODES):
        parts = fv.DOSHAS if code == "tridosha" else code.split("-")
        rows.append((code, ", ".join(parts), order))
    return dim(spark, rows, "dosha string, components string, sort_order int")


def synonyms(spark: SparkSession) -> DataFrame:
    return dim(spark, fv.SYNONYMS.items(), "phrase string, preferred string")


def red_flags(spark: SparkSession) -> DataFrame:
    return dim(spark, fv.RED_FLAGS, "code string, advice string")


def symptom_triggers(spark: SparkSession) -> DataFrame:
    advice = dict(fv.RED_FLAGS)
    rows = [(s, c, advice[c]) for s, c in fv.SYMPTOM_TRIGGERS]
    return dim(spark, rows, "symptom string, code string, advice string")


def evidence_weights(spark: SparkSession) -> DataFrame:
    return dim(
        spark, fv.EVIDENCE_WEIGHTS, "source string, item string, dosha string, weight double"
    )


def season_states(spark: SparkSession) -> DataFrame:
    """(season, dosha, state, weight): 18 rows."""
    rows = []
    for season, *_ in fv.SEASONS:
        for dosha in fv.DOSHAS:
            state = fv.DOSHA_CYCLE[dosha].get(season, "neutral")
            rows.append((season, dosha, state, fv.STATE_WEIGHTS[state]))
    return dim(spark, rows, "season string, dosha string, state string, weight double")


def habitat_doshas(spark: SparkSession) -> DataFrame:
    rows = [(h, d) for h, doshas in fv.HABITAT_DOSHAS.items() for d in doshas]
    return dim(spark, rows, "habitat string, dosha string")


def sign_table(spark: SparkSession) -> DataFrame:
    """(kind, entity, side, sign) over subdoshas, tissues and channels."""
    rows = [("subdosha", name, "sign", s) for name, *_, signs in fv.SUBDOSHAS for s in signs]
    for name, _, low, high in fv.DHATUS:
        rows += [("tissue", name, "kshaya", s) for s in low]
        rows += [("tissue", name, "vriddhi", s) for s in high]
    rows += [("channel", name, "sign", s) for name, _, signs in fv.SROTAS for s in signs]
    return dim(spark, rows, "kind string, entity string, side string, sign string")


def option_signals(spark: SparkSession) -> DataFrame:
    """(module, question, option, vata, pitta, kapha, sattva, rajas, tamas)."""
    rows = []
    for module, question, option, signals in fv.MODULE_OPTIONS:
        rows.append((module, question, option, *[float(signals.get(d, 0.0)) for d in fv.DOSHAS], 0.0, 0.0, 0.0))
    for question in fv.MANAS_QUESTIONS:
        for option, guna in fv.MANAS_OPTIONS:
            rows.append(("manas_prakriti", question, option, 0.0, 0.0, 0.0,
                         *[1.0 if g == guna else 0.0 for g in fv.GUNAS]))
    return dim(
        spark, rows,
        "module string, question string, option string, vata double, pitta double, kapha double, "
        "sattva double, rajas double, tamas double",
    )


def ojas_points(spark: SparkSession) -> DataFrame:
    best = {}
    for question, _, points in fv.OJAS_POINTS:
        best[question] = max(points, best.get(question, 0))
    rows = [(q, o, p, best[q]) for q, o, p in fv.OJAS_POINTS]
    return dim(spark, rows, "question string, option string, points int, best int")


def routine_points(spark: SparkSession) -> DataFrame:
    return dim(spark, fv.ROUTINE_POINTS, "item string, points int")


def food_tastes(spark: SparkSession) -> DataFrame:
    rows = [(food, taste) for food, tastes, _ in fv.FOODS for taste in tastes]
    return dim(spark, rows, "food string, taste string")


def food_tags(spark: SparkSession) -> DataFrame:
    rows = [(food, tag) for food, _, tags in fv.FOODS for tag in tags]
    return dim(spark, rows, "food string, tag string")


def meal_rules(spark: SparkSession) -> DataFrame:
    """(rule_id, tag, needed, only_meal, message): one row per required tag."""
    rows = [
        (i, tag, len(tags), meal, message)
        for i, (tags, meal, message) in enumerate(fv.MEAL_RULES)
        for tag in tags
    ]
    return dim(spark, rows, "rule_id int, tag string, needed int, only_meal string, message string")


def taste_effects(spark: SparkSession) -> DataFrame:
    return dim(spark, fv.TASTE_EFFECTS, "taste string, vata int, pitta int, kapha int")
