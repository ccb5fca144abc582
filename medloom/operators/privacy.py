"""Consent-aware selection, k-anonymous tables, case views, export and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import dosha_components
from .longitudinal import consented, consents_in_force
from .skew import dense_index


# --- learning cases ----------------------------------------------------------------------------
def eligible_cases(reviews: DataFrame, encounters: DataFrame, consents: DataFrame) -> DataFrame:
    """(review_id, encounter_id, patient_id, condition_id, created_at) usable for learning."""
    kept = reviews.where(F.col("decision").isin(*fv.LEARNING_DECISIONS) & F.col("condition_id").isNotNull())
    joined = kept.select(F.col("id").alias("review_id"), "encounter_id", "condition_id", "created_at").join(
        encounters.select(F.col("id").alias("encounter_id"), "patient_id"), "encounter_id")
    users = consented(consents, "research").withColumnRenamed("user_id", "patient_id")
    return joined.join(users, "patient_id", "left_semi")


def time_split(cases: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """Add ``part``: the oldest ``share`` is train, the newest rest is holdout."""
    placed = dense_index(cases, [F.col(c) for c in order], "_idx")
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * share)
    return placed.join(F.broadcast(total)).withColumn(
        "part", F.when(F.col("_idx") < cut, "train").otherwise("holdout")).drop("_idx", "_n")


# --- published tables ---------------------------------------------------------------------------
def k_anonymous(rows: DataFrame, cell: list[str], person: str, k: int = fv.K_ANONYMITY, by: str = "people") -> DataFrame:
    """Counts per cell, cells under ``k`` suppressed.

    ``by="people"`` counts distinct people against k; ``by="rows"`` counts rows, as a looser table.
    Distinct pairs are made first, so a person or cell with very many rows is collapsed map-side.
    """
    per_person = rows.groupBy(*cell, person).agg(F.count(F.lit(1)).alias("_n"))
    out = per_person.groupBy(*cell).agg(F.sum("_n").alias("count"), F.count(F.lit(1)).alias("people"))
    return out.where(F.col("people" if by == "people" else "count") >= k)


def population_insights(reviews: DataFrame, encounters: DataFrame, conditions: DataFrame, by: str = "people") -> DataFrame:
    """(table, key1, key2, count): season x system, habitat x dosha, season x condition."""
    kept = reviews.where(F.col("decision").isin(*fv.LEARNING_DECISIONS)).select("encounter_id", "condition_id")
    rows = kept.join(encounters.select(F.col("id").alias("encounter_id"), "patient_id", "ritu", "desha"), "encounter_id").join(
        conditions.select("condition_id", "name", "body_system", "dosha"), "condition_id")
    cells = F.concat(
        F.array(
            F.struct(F.lit("season_system").alias("table"), F.col("ritu").alias("key1"), F.col("body_system").alias("key2")),
            F.struct(F.lit("season_condition").alias("table"), F.col("ritu").alias("key1"), F.col("name").alias("key2")),
        ),
        F.transform(dosha_components(F.col("dosha")), lambda d: F.struct(
            F.lit("habitat_dosha").alias("table"), F.col("desha").alias("key1"), d.alias("key2"))),
    )
    long = rows.select("patient_id", F.explode(cells).alias("c")).select("patient_id", "c.*")
    return k_anonymous(long, ["table", "key1", "key2"], "patient_id", by=by)


# --- practitioner views -------------------------------------------------------------------------
def triage_priority(level: Column) -> Column:
    return F.when(level == "emergency", 0).when(level == "urgent", 1).otherwise(2)


def review_queue(encounters: DataFrame, practitioner: str, status: str = "submitted") -> DataFrame:
    """Emergencies, then urgent, then the rest; oldest first. Free or own cases only."""
    mine = F.col("practitioner_id").isNull() | (F.col("practitioner_id") == practitioner)
    return encounters.where((F.col("status") == status) & mine).withColumn(
        "priority", triage_priority(F.col("triage_level"))).orderBy("priority", "created_at", "id")


def visible_cases(encounters: DataFrame, consents: DataFrame, practitioner: str) -> DataFrame:
    open_case = F.col("status").isin("submitted", "reviewed") & (
        F.col("practitioner_id").isNull() | (F.col("practitioner_id") == practitioner))
    users = consented(consents, "care").withColumnRenamed("user_id", "patient_id")
    return encounters.where(open_case).join(users, "patient_id", "left_semi")


def case_dossier(visible: DataFrame, differential: DataFrame, conditions: DataFrame, profiles: DataFrame, shown: int = 8) -> DataFrame:
    """(encounter_id, rank, condition, reference): one row per shown candidate of each case.

    ``differential`` is (encounter_id, rank, condition_id); the references are dimensions.
    """
    first = differential.where(F.col("rank") <= shown)
    cases = visible.select(F.col("id").alias("encounter_id"), "patient_id", "triage_level")
    refs = conditions.select("condition_id", "name", "body_system", "prognosis", "age_low", "age_high").join(profiles, "condition_id", "left")
    return cases.join(first, "encounter_id").join(refs, "condition_id")


# --- rights of the person ---------------------------------------------------------------------------
def export_rows(sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(user_id, section, payload): everything held about each user as JSON lines.

    One line per stored row; write with ``partitionBy("user_id")`` or bucket by it. A user with
    very many rows is many lines, never one document built in memory.
    """
    out = None
    for name, (df, user) in sections.items():
        rest = [c for c in df.columns if c != user]
        part = df.select(F.col(user).alias("user_id"), F.lit(name).alias("section"), F.to_json(F.struct(*rest)).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def withdraw_location(profiles: DataFrame, consents: DataFrame, columns: list[str]) -> DataFrame:
    """Clear location columns of users whose location consent is withdrawn."""
    state = consents_in_force(consents.where("purpose = 'location'")).select("user_id", F.col("granted").alias("_granted"))
    joined = profiles.join(state, "user_id", "left")
    gone = F.col("_granted").isNotNull() & ~F.col("_granted")
    return joined.select(*[F.when(~gone, F.col(c)).alias(c) if c in columns else F.col(c) for c in profiles.columns])


def audit_rows(actions: DataFrame, actor: str, action: Column, entity: Column, entity_id: Column, details: dict[str, Column]) -> DataFrame:
    """Rows for the append-only audit trail; details as a string map."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return actions.select(
        F.col(actor).alias("actor_id"), action.alias("action"), entity.alias("entity"), entity_id.cast("string").alias("entity_id"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("details"))


def erase(tables: dict[str, tuple[DataFrame, str]], users: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``users`` (user_id)."""
    out = {}
    for name, (df, key) in tables.items():
        out[name] = df.join(users.select(F.col("user_id").alias(key)), key, "left_anti")
    return out
