"""Star-schema reads: overview, cross-tabs, nested profiles, KPIs, enrichment, ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.stats import benjamini_hochberg, hypergeometric_tail
from ..functions.text import dosha_components
from .quantiles import quantiles


def overview(dimension: DataFrame, key: str, facts: list[tuple[DataFrame, list[Column]]], order: str) -> DataFrame:
    """A dimension left-joined to one pre-aggregate per fact.

    Each fact shrinks to one row per key before it meets the others, so the joins see as many
    rows as the dimension has.
    """
    out = dimension
    for fact, measures in facts:
        out = out.join(fact.where(F.col(key).isNotNull()).groupBy(key).agg(*measures), key, "left")
    return out.orderBy(order)


def cluster_by_system(bridge: DataFrame, symptom_cluster: DataFrame, conditions: DataFrame) -> DataFrame:
    """(cluster_id, body_system, conditions): distinct conditions per cell."""
    clustered = symptom_cluster.where("cluster_id >= 0").select("symptom", "cluster_id")
    pairs = bridge.join(clustered, "symptom").select("condition_id", "cluster_id").distinct()
    return (
        pairs.join(conditions.select("condition_id", "body_system"), "condition_id")
        .groupBy("cluster_id", "body_system").agg(F.count(F.lit(1)).alias("conditions"))
    )


def nested_profiles(conditions: DataFrame, bridge: DataFrame) -> DataFrame:
    """One row per condition with its sorted symptom set; bounded by the vocabulary."""
    lists = bridge.groupBy("condition_id").agg(F.sort_array(F.collect_set("symptom")).alias("symptoms"))
    return conditions.where("NOT profile_conflict").join(lists, "condition_id")


def kpis(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of scalar counts."""
    parts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in counts.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


def enrichment(rows: DataFrame, cluster: str, dosha: str) -> DataFrame:
    """(cluster, component, n, share, lift, p_value, q_value): over-representation per cluster.

    Everything after the first aggregate works on clusters x 3 rows.
    """
    known = rows.where((F.col(cluster) >= 0) & F.col(dosha).isNotNull())
    parts = dosha_components(F.col(dosha))
    cells = known.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains(parts, d)).alias(d) for d in fv.DOSHAS]
    )
    long = cells.select("cluster", "n", F.explode(F.array(*[
        F.struct(F.lit(d).alias("component"), F.col(d).alias("hits")) for d in fv.DOSHAS
    ])).alias("c")).select("cluster", "n", "c.*")
    by_component = W.partitionBy("component")
    full = long.withColumn("all_n", F.sum("n").over(by_component)).withColumn("all_hits", F.sum("hits").over(by_component))
    tested = full.select(
        "cluster", "component", "n", (F.col("hits") / F.col("n")).alias("share"),
        (F.col("hits") / F.col("n") / (F.col("all_hits") / F.col("all_n"))).alias("lift"),
        hypergeometric_tail("hits", "n", "all_hits", "all_n").alias("p_value"),
    )
    return benjamini_hochberg(tested, "p_value", ["cluster", "component"], "q_value")


def dosha_llr(bridge: DataFrame, conditions: DataFrame, m: float = fv.LLR_PSEUDO_COUNT) -> DataFrame:
    """(symptom, dosha, llr): evidence of a symptom for each dosha, shrunk to the base rate."""
    known = conditions.where(F.col("dosha").isNotNull() & ~F.col("profile_conflict")).select(
        "condition_id", dosha_components(F.col("dosha")).alias("parts"))
    share = [F.avg(F.array_contains("parts", d).cast("double")).alias(f"base_{d}") for d in fv.DOSHAS]
    base = known.agg(*share)
    per = bridge.join(known, "condition_id").groupBy("symptom").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.array_contains("parts", d)).alias(d) for d in fv.DOSHAS]
    )
    long = per.join(F.broadcast(base)).select("symptom", "n", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dosha"), F.col(d).alias("hits"), F.col(f"base_{d}").alias("base")) for d in fv.DOSHAS
    ])).alias("c")).select("symptom", "n", "c.*")
    p = (F.col("hits") + m * F.col("base")) / (F.col("n") + m)
    logit = lambda x: F.log(x) - F.log(1 - x)
    # A dosha that no or every known condition has carries no evidence.
    return long.select("symptom", "dosha", F.coalesce(F.round(logit(p) - logit(F.col("base")), 4), F.lit(0.0)).alias("llr"))


def base_rates(conditions: DataFrame) -> DataFrame:
    known = conditions.where(F.col("dosha").isNotNull() & ~F.col("profile_conflict"))
    parts = dosha_components(F.col("dosha"))
    return known.agg(*[F.avg(F.array_contains(parts, d).cast("double")).alias(f"base_{d}") for d in fv.DOSHAS])


def habitat_class(rain: Column, humidity: Column) -> Column:
    return (
        F.when((rain > 1500) | (humidity > 78), F.lit("anupa")).when(rain < 750, F.lit("jangala")).otherwise(F.lit("sadharana"))
    )


def climate_cells(readings: DataFrame, keys: list[str], rain: str, humidity: str, temperature: str) -> DataFrame:
    """Yearly climate per cell; the class is taken from the rounded figures."""
    sums = readings.groupBy(*keys).agg(
        F.bround(F.sum(F.coalesce(F.col(rain), F.lit(0.0))), 1).alias("annual_precip_mm"),
        F.bround(F.avg(humidity), 1).alias("mean_rh"),
        F.bround(F.avg(temperature), 1).alias("mean_temp_c"),
    )
    return sums.withColumn("habitat", habitat_class(F.col("annual_precip_mm"), F.col("mean_rh")))


def stale_cells(wanted: DataFrame, cache: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Cells to compute again: absent from the cache or older than ``days``."""
    fresh = cache.where(F.col("fetched_at") > as_of - F.make_dt_interval(F.lit(days)))
    return wanted.join(fresh.select("cell"), "cell", "left_anti")


def reference_row(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """One row: most frequent level (ties to the smallest) and exact median."""
    modes = None
    for c in categories:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        one = counts.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
        modes = one if modes is None else modes.crossJoin(one)
    out = modes if modes is not None else df.sparkSession.range(1).select()
    if not numbers:
        return out
    middles = quantiles(df, numbers, [0.5]).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in numbers])
    return out.crossJoin(middles)  # one row each


def top_conditions(conditions: DataFrame, sizes: DataFrame, n: int = 10) -> DataFrame:
    """Largest profiles of every cluster; the limit is applied before the shuffle too."""
    ranked = W.partitionBy("cluster_id").orderBy(F.col("n_symptoms").desc(), "condition_id")
    return (
        conditions.join(sizes, "condition_id").withColumn("position", F.row_number().over(ranked))
        .where(F.col("position") <= n)
    )


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def average_rank(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Tie-averaged rank over a table of one row per tested item."""
    w = W.partitionBy(F.lit(1)).orderBy(value)
    ties = W.partitionBy(value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def consensus_rank(df: DataFrame, ascending: list[str], descending: list[str]) -> DataFrame:
    names = []
    for c in ascending + descending:
        df = average_rank(df, F.col(c) if c in ascending else -F.col(c), f"_r_{c}")
        names.append(F.col(f"_r_{c}"))
    mean = sum(names[1:], names[0]) / len(names)
    out = df.withColumn("_mean", F.round(mean, 9))
    return out.withColumn("consensus_rank", F.rank().over(W.partitionBy(F.lit(1)).orderBy("_mean"))).drop(
        "_mean", *[f"_r_{c}" for c in ascending + descending])


def first_by(df: DataFrame, key: Column, order: list[str], name: str = "_key") -> DataFrame:
    """First row per key by an explicit order; partial aggregation keeps one row per key and task."""
    kept = [c for c in df.columns]
    best = df.groupBy(key.alias(name)).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def union_bases(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks become NULL."""
    return left.unionByName(right, allowMissingColumns=True)


def evidence_sets(profile: Column, present: Column, denied: Column, shown: int = 6) -> list[Column]:
    """supporting, typical but denied, unexplained, typical and not yet asked (first ``shown``)."""
    arr = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    p, yes, no = arr(profile), arr(present), arr(denied)
    return [
        F.array_sort(F.array_intersect(yes, p)).alias("supporting"),
        F.array_sort(F.array_intersect(no, p)).alias("denied_typical"),
        F.array_sort(F.array_except(yes, p)).alias("unexplained"),
        F.slice(F.array_sort(F.array_except(F.array_except(p, yes), no)), 1, shown).alias("not_yet_asked"),
    ]


