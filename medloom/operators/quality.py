"""Data-quality gate: duplicate, null, identity, text, conflict and signal checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import fold_case
from ..session import cut_lineage
from .skew import dense_index, lookup

CHECK_COLUMNS = ["source", "check_name", "value", "threshold", "passed", "blocking"]


def as_code(c):
    """Category code as text; NULL is a level of its own."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


# --- duplicates and nulls -----------------------------------------------------------------------
def duplicate_rate(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: share of rows that repeat an earlier row (NULLs equal)."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_rate"))


def null_rate(df: DataFrame) -> DataFrame:
    """One row: mean over columns of the share of NULLs; a single scan."""
    shares = [F.avg(F.col(c).isNull().cast("double")) for c in df.columns]
    return df.agg((sum(shares[1:], shares[0]) / F.lit(len(shares))).alias("null_rate"))


def chance_duplicate_rate(
    df: DataFrame, columns: list[str], label: str | None, row_id: str, reps: int = 5, seed: int = 0
) -> DataFrame:
    """Duplicate rate when every column is shuffled on its own within each label class.

    Each (rep, column, class) is put in hash order by one range sort over all of them, so a class
    holding most rows is still spread over many tasks; equal positions then form the new rows.
    """
    shuffled = [c for c in columns if c != label]
    kept = df.where(F.col(label).isNotNull()) if label else df
    klass = as_code(F.col(label)) if label else F.lit("")
    long = kept.select(
        F.col(row_id).alias("_id"),
        klass.alias("_class"),
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value"))
            for i, c in enumerate(shuffled)
        ])).alias("cell"),
        ).select("_id", "_class", "cell.*")
    long = long.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = F.xxhash64(F.lit(seed), "rep", "column", "_id")
    placed = dense_index(long.withColumn("_h", order), [F.col(c) for c in ("rep", "column", "_class", "_h", "_id")])
    starts = placed.groupBy("rep", "column", "_class").agg(F.min("idx").alias("start"))
    cells = placed.join(starts, ["rep", "column", "_class"]).withColumn("pos", F.col("idx") - F.col("start"))
    rows = cells.groupBy("rep", "_class", "pos").agg(*[
        F.max(F.when(F.col("column") == i, F.col("value"))).alias(f"v{i}") for i in range(len(shuffled))
    ])
    by_value = [f"v{i}" for i in range(len(shuffled))] + (["_class"] if label else [])
    groups = rows.groupBy("rep", *by_value).agg(F.count(F.lit(1)).alias("n"))
    rates = groups.groupBy("rep").agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("rate"))
    return rates.agg(F.avg("rate").alias("chance_rate"))


# --- identity and text ----------------------------------------------------------------------------
def identity_columns(df: DataFrame) -> DataFrame:
    """(column, distinct_ratio, is_identity) for columns whose name suggests a person."""
    named = [c for c in df.columns if re.search(fv.PII_NAME, c)]
    if not named:
        return df.sparkSession.createDataFrame([], "column string, distinct_ratio double, is_identity boolean")
    totals = df.agg(*[
        F.when(F.count(c) > 0, F.countDistinct(F.col(c).cast("string")) / F.count(c)).alias(c) for c in named
    ])
    long = totals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct_ratio")) for c in named
    ])).alias("r")).select("r.*")
    return long.withColumn("is_identity", F.coalesce(F.col("distinct_ratio") > 0.5, F.lit(False)))


def text_uniqueness(df: DataFrame, text: str, entity: str) -> DataFrame:
    """Distinct texts per distinct entity. Digests are counted, so whole texts never shuffle."""
    return df.agg(
        F.countDistinct(F.sha2(F.col(text), 256)).alias("texts"),
        F.countDistinct(entity).alias("entities"),
    ).select("texts", "entities", (F.col("texts") / F.greatest(F.col("entities"), F.lit(1))).alias("uniqueness"))


def content_words(c):
    words = F.array_distinct(F.regexp_extract_all(fold_case(c), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.filter(words, lambda w: ~w.isin(*fv.CONFLICT_STOP_WORDS))


def conflicting_rows(df: DataFrame, row_id: str, entity: str, text: str) -> DataFrame:
    """Rows that share no content word with any other row of the same entity."""
    rows = cut_lineage(df.select(
        F.col(row_id).alias("row_id"),
        F.trim(fold_case(as_code(F.col(entity)))).alias("entity"),
        content_words(as_code(F.col(text))).alias("words"),
    ))
    # A row is backed unless it is the only holder of each word it lists, so holders are counted and never looked up.
    holders = rows.select("row_id", "entity", F.explode("words").alias("word")).groupBy("entity", "word").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("row_id"))
    own = holders.where("n_rows = 1").groupBy("row_id").agg(F.count(F.lit(1)).alias("n_own"))
    listed = rows.groupBy("row_id").agg(F.sum(F.size("words")).alias("n_words"))
    backed = listed.join(own, "row_id", "left").where("n_words > coalesce(n_own, 0)").select("row_id")
    sizes = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_rows"))
    lonely = rows.select("row_id", "entity").join(backed, "row_id", "left_anti")
    return (
        lookup(lonely, sizes, "entity", ["entity_rows"], "entity_rows", F.col("row_id"))
        .where("entity_rows >= 2").select("row_id", "entity")
    )


# --- signal ------------------------------------------------------------------------------------------
def contingency(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, x, y, n) for all features in one scan, pre-aggregated before the shuffle."""
    long = df.select(
        as_code(F.col(label)).alias("y"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), as_code(F.col(f)).alias("x")) for f in features
        ])).alias("f"),
    ).select("f.feature", "f.x", "y")
    return long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def information_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mutual information in nats of x and y per ``keys`` from (keys, x, y, n)."""
    px = cells.groupBy(*keys, "x").agg(F.sum("n").alias("n_x"))
    py = cells.groupBy(*keys, "y").agg(F.sum("n").alias("n_y"))
    pn = cells.groupBy(*keys).agg(F.sum("n").alias("n_all"))
    joined = cells.join(px, [*keys, "x"]).join(py, [*keys, "y"]).join(pn, keys)
    n, nx, ny, na = (F.col(c).cast("double") for c in ("n", "n_x", "n_y", "n_all"))
    return joined.groupBy(*keys).agg(F.sum(n / na * F.log(n * na / (nx * ny))).alias("mi"))


def mutual_information(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return information_from_cells(contingency(df, features, label), ["feature"])


def candidate_features(df: DataFrame, label: str, max_levels: int = 50) -> DataFrame:
    """(feature, levels) of usable categorical features; one scan for all columns."""
    named = [c for c in df.columns if c != label and not re.search(fv.PII_NAME, c)]
    counted = df.agg(*[F.countDistinct(c).alias(c) for c in named])
    long = counted.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("levels")) for c in named
    ])).alias("r")).select("r.*")
    return long.where((F.col("levels") > 1) & (F.col("levels") <= max_levels))


def _table_information(table: np.ndarray) -> float:
    total = table.sum()
    p = table / total
    outer = np.outer(p.sum(1), p.sum(0))
    hit = p > 0
    return float((p[hit] * np.log(p[hit] / outer[hit])).sum())


def _random_table(rows: np.ndarray, cols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A contingency table with given margins, distributed as under a random shuffle."""
    left = cols.copy()
    out = np.zeros((len(rows), len(cols)), dtype=np.int64)
    for i, need in enumerate(rows[:-1]):
        rest = int(left.sum())
        for j in range(len(cols) - 1):
            if need == 0:
                break
            rest -= int(left[j])
            got = int(rng.hypergeometric(int(left[j]), rest, int(need))) if left[j] + rest else 0
            out[i, j] = got
            left[j] -= got
            need -= got
        if need:
            out[i, -1] += need
            left[-1] -= need
    out[-1] = left
    return out


def _draw_null(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        values = []
        for r in frame.itertuples(index=False):
            rows = np.asarray(r.row_sums, dtype=np.int64)
            cols = np.asarray(r.col_sums, dtype=np.int64)
            rng = np.random.default_rng([int(r.stream) & 0x7FFFFFFF, int(r.rep)])
            total = int(rows.sum())
            if total < 1_000_000_000:
                values.append(_table_information(_random_table(rows, cols, rng)))
            else:
                # Beyond the sampler's range 2*n*MI follows chi-square to about 1/n.
                values.append(float(rng.chisquare((len(rows) - 1) * (len(cols) - 1)) / (2 * total)))
        yield pd.DataFrame({"feature": frame["feature"], "rep": frame["rep"], "null_mi": values})


def permutation_information(cells: DataFrame, reps: int = 200, seed: int = 0) -> DataFrame:
    """(feature, mi, p_value) by shuffling the label ``reps`` times.

    A shuffle keeps both margins, so the null table is drawn from the margins alone: the cost does
    not depend on the number of rows.
    """
    observed = information_from_cells(cells, ["feature"])

    def margin(axis: str, name: str) -> DataFrame:
        sums = cells.groupBy("feature", axis).agg(F.sum("n").alias("s"))
        return sums.groupBy("feature").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(axis, "s"))), lambda t: t["s"]).alias(name)
        )

    margins = margin("x", "row_sums").join(margin("y", "col_sums"), "feature")
    tasks = margins.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "stream", F.xxhash64(F.lit(seed), "feature")
    ).repartition("feature", "rep")
    null = tasks.mapInPandas(_draw_null, "feature string, rep int, null_mi double")
    return (
        null.join(observed, "feature")
        .groupBy("feature", "mi")
        .agg(((F.sum((F.col("null_mi") >= F.col("mi") - 1e-12).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    )


def noise_features(df: DataFrame, features: list[str], label: str, alpha: float, reps: int = 200, seed: int = 0) -> DataFrame:
    """(feature, mi, p_value, is_noise)."""
    tested = permutation_information(contingency(df, features, label), reps, seed)
    return tested.withColumn("is_noise", F.col("p_value") > alpha)


# --- the gate -------------------------------------------------------------------------------------------
def _check(frame: DataFrame, source: str, name: str, value, threshold, passed, blocking: bool) -> DataFrame:
    return frame.select(
        F.lit(source).alias("source"),
        F.lit(name).alias("check_name"),
        value.cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
        passed.alias("passed"),
        F.lit(blocking).alias("blocking"),
    )


def audit(
    df: DataFrame, source: str, row_id: str, role: str = "assessment", label: str | None = None,
    text: str | None = None, entity: str | None = None, gate: dict | None = None,
    reps: int = 5, permutations: int = 200, seed: int = 0,
) -> DataFrame:
    """All checks of one source, one row each."""
    gate = {**fv.GATE, **(gate or {})}
    body = df.drop(row_id)
    columns = body.columns
    label = label if label in columns else None
    limit = gate["max_duplicate_rate"]

    observed = duplicate_rate(body)
    chance = chance_duplicate_rate(df, columns, label, row_id, reps, seed)
    excess = F.when(F.col("duplicate_rate") > 0, F.col("duplicate_rate") - F.col("chance_rate")).otherwise(0.0)
    checks = [
        _check(observed.crossJoin(chance), source, "excess_duplicate_rate", excess, limit, excess <= limit, True)
    ]
    nulls = F.col("null_rate")
    checks.append(_check(null_rate(body), source, "null_rate", nulls, gate["max_null_rate"], nulls <= gate["max_null_rate"], True))

    person_level = role in ("patient_cohort", "assessment", "audit_only")
    identity: list[str] = []
    if person_level:
        # One row per column of the schema: a bounded driver-side list.
        identity = [r["column"] for r in identity_columns(body).where("is_identity").collect()]
    one = df.sparkSession.range(1)
    checks.append(_check(one, source, "pii_columns", F.lit(len(identity)), 0.0, F.lit(not identity), False))

    if text and entity:
        u = F.col("uniqueness")
        checks.append(_check(text_uniqueness(df, text, entity), source, "text_uniqueness", u,
                             gate["min_text_uniqueness"], u >= gate["min_text_uniqueness"], True))
        clashes = conflicting_rows(df, row_id, entity, text).agg(F.count(F.lit(1)).alias("n"))
        checks.append(_check(clashes, source, "conflicting_entity_profiles", F.col("n"), 0.0, F.col("n") == 0, False))

    if label and person_level:
        features = [r["feature"] for r in candidate_features(body, label).collect()]
        if features:
            tested = noise_features(df, features, label, gate["noise_feature_alpha"], permutations, seed)
            noise = sorted(r["feature"] for r in tested.where("is_noise").select("feature").collect())
            share = len(noise) / len(features)
            top = gate["max_noise_feature_share"]
            checks.append(_check(one, source, "noise_feature_share", F.lit(share), top, F.lit(share <= top), False))
            signal = [c for c in columns if c not in set(noise) | set(identity)]
            if noise and len(signal) > 1:
                seen = duplicate_rate(df.select(signal))
                by_chance = chance_duplicate_rate(df, signal, label, row_id, reps, seed)
                over = F.col("duplicate_rate") - F.col("chance_rate")
                checks.append(_check(seen.crossJoin(by_chance), source, "excess_signal_duplicate_rate",
                                     over, limit, over <= limit, True))
    out = checks[0]
    for extra in checks[1:]:
        out = out.unionByName(extra)
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """(source, passed): every blocking check must pass."""
    return checks.groupBy("source").agg(F.min((F.col("passed") | ~F.col("blocking")).cast("int")).alias("ok")).select(
        "source", (F.col("ok") == 1).alias("passed")
    )


def require(checks: DataFrame, required: list[str]) -> None:
    """Abort the run when a required source is rejected."""
    failed = [r["source"] for r in verdict(checks).where(~F.col("passed") & F.col("source").isin(*required)).collect()]
    if failed:
        raise RuntimeError(f"quality gate rejected required sources: {sorted(failed)}")


