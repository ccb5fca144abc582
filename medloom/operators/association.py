"""Association tests, adjusted effects, stability and permutation importance of cohort variables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.stats import benjamini_hochberg, chi2_tail, normal_two_sided
from ..session import cut_lineage
from .many_fits import fit_binary
from .quality import contingency
from .selection import fold_of
from .skew import dense_index
from .warehouse import consensus_rank


# --- contingency tests ------------------------------------------------------------------------------
def chi_square_tests(df: DataFrame, variables: list[str], outcome: str) -> DataFrame:
    """(variable, chi2, dof, p_value, effect): Yates-corrected p on 2x2, bias-corrected Cramer's V.

    One scan builds all tables; the rest works on their cells. Empty cells follow from the margins.
    """
    cells = contingency(df.where(F.col(outcome).isNotNull()), variables, outcome)
    rows = cells.groupBy("feature", "x").agg(F.sum("n").alias("rx"))
    cols = cells.groupBy("feature", "y").agg(F.sum("n").alias("cy"))
    size = cells.groupBy("feature").agg(F.sum("n").alias("t"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("k"))
    grid = rows.join(cols, "feature").join(cells, ["feature", "x", "y"], "left").join(size, "feature")
    n = F.coalesce("n", F.lit(0)).cast("double")
    expected = F.col("rx") * F.col("cy") / F.col("t")
    gap = F.abs(n - expected)
    square = lambda g: F.sum(g * g / expected)
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    shrunk = F.when(dof == 1, F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))).otherwise(gap)
    sums = grid.groupBy("feature", "t", "r", "k").agg(square(gap).alias("chi2"), square(shrunk).alias("chi2_c"))
    t, r, k = F.col("t"), F.col("r"), F.col("k")
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / t - (k - 1) * (r - 1) / (t - 1))
    rc, kc = r - (r - 1) * (r - 1) / (t - 1), k - (k - 1) * (k - 1) / (t - 1)
    room = F.least(rc - 1, kc - 1)
    return sums.select(
        F.col("feature").alias("variable"), "chi2", ((r - 1) * (k - 1)).alias("dof"),
        chi2_tail(F.col("chi2_c"), ((r - 1) * (k - 1)).cast("double")).alias("p_value"),
        F.when(room > 0, F.sqrt(phi2 / room)).otherwise(0.0).alias("effect"))


def mann_whitney(df: DataFrame, variables: list[str], outcome: str) -> DataFrame:
    """(variable, u, p_value, effect): two-sided rank test with ties, from counts per distinct value."""
    known = df.where(F.col(outcome).isNotNull())
    long = known.select(F.col(outcome).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables])).alias("c")).select("y", "c.*").where("x IS NOT NULL")
    values = long.groupBy("variable", "x").agg(F.count_if(F.col("y") == 1).alias("n1"), F.count(F.lit(1)).alias("n"))
    # Positions run over distinct values, placed by one range sort rather than one window per variable.
    placed = cumulative(values, ["variable"], "x", ["n"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    n3 = F.col("n").cast("double")
    sums = placed.groupBy("variable").agg(
        F.sum(F.col("n1") * rank).alias("r1"), F.sum("n1").cast("double").alias("a"), F.sum("n").cast("double").alias("t"),
        F.sum(n3 * n3 * n3 - n3).alias("ties"))
    a, t = F.col("a"), F.col("t")
    b = t - a
    u = F.col("r1") - a * (a + 1) / 2
    spread = F.sqrt(a * b / 12 * (t + 1 - F.col("ties") / (t * (t - 1))))
    z = (F.abs(u - a * b / 2) - 0.5) / spread
    return sums.select("variable", u.alias("u"), F.least(F.lit(1.0), normal_two_sided(F.greatest(z, F.lit(0.0)))).alias("p_value"),
                       (2 * u / (a * b) - 1).alias("effect"))


def cumulative(df: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """Add ``before_<c>``: sum of ``c`` over the rows of the group that come earlier.

    Range-partitioned: each task adds up its own stretch and a table of one row per task and group
    carries the sums over, so a group may span any number of tasks.
    """
    parts = cut_lineage(df.orderBy(*group, order).withColumn("_p", F.spark_partition_id()))
    inner = W.partitionBy(*group, "_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{c}") for c in columns])
    stretch = parts.groupBy(*group, "_p").agg(*[F.sum(c).alias(c) for c in columns])
    outer = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carried = stretch.select(*group, "_p", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_up_{c}") for c in columns])
    joined = local.join(carried, [*group, "_p"])
    return joined.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_up_{c}")).alias(f"before_{c}") for c in columns])


def auc(df: DataFrame, score: str, outcome: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(group, auc, positives, negatives) by rank sum from counts per distinct score."""
    g = group or []
    w = F.col(weight) if weight else F.lit(1)
    values = df.groupBy(*g, score).agg(F.sum(F.when(F.col(outcome) == 1, w).otherwise(0)).alias("n1"), F.sum(w).alias("n"))
    keyed = values if g else values.withColumn("_g", F.lit(0))
    placed = cumulative(keyed, g or ["_g"], score, ["n"])
    sums = placed.groupBy(*g).agg(
        F.sum(F.col("n1") * (F.col("before_n") + (F.col("n") + 1) / 2.0)).alias("r1"), F.sum("n1").alias("a"), F.sum("n").alias("t"))
    a, b = F.col("a").cast("double"), (F.col("t") - F.col("a")).cast("double")
    return sums.select(*g, F.when((a > 0) & (b > 0), (F.col("r1") - a * (a + 1) / 2) / (a * b)).alias("auc"),
                       F.col("a").alias("positives"), (F.col("t") - F.col("a")).alias("negatives"))


def univariate(df: DataFrame, categorical: list[str], numeric: list[str], outcome: str) -> DataFrame:
    """(variable, test, effect, p_value, q_value) over all variables."""
    parts = []
    if categorical:
        parts.append(chi_square_tests(df, categorical, outcome).select("variable", F.lit("chi-square").alias("test"), "effect", "p_value"))
    if numeric:
        parts.append(mann_whitney(df, numeric, outcome).select("variable", F.lit("mann-whitney").alias("test"), "effect", "p_value"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return benjamini_hochberg(both, "p_value", ["variable"], "q_value")


# --- design and adjusted effects ------------------------------------------------------------------------
def design(df: DataFrame, categorical: list[str], numeric: list[str], outcome: str, tens: tuple[str, ...] = ("age",)) -> tuple[DataFrame, dict[str, list[str]]]:
    """Dummy-coded columns, most frequent level left out; ages per ten years.

    The level tables read here have one row per level of each categorical variable.
    """
    known = df.where(F.col(outcome).isNotNull())
    out, groups = [], {}
    if categorical:
        counts = contingency(known, categorical, outcome).groupBy("feature", "x").agg(F.sum("n").alias("n")).collect()
        for v in categorical:
            levels = sorted(((r["x"], r["n"]) for r in counts if r["feature"] == v), key=lambda t: (-t[1], t[0]))
            groups[v] = []
            for level, _ in sorted(levels[1:]):
                name = f"{v}={level}"
                groups[v].append(name)
                out.append((F.coalesce(F.col(v).cast("string"), F.lit("nan")) == level).cast("double").alias(name))
    for v in numeric:
        name = f"{v}_per_10y" if v in tens else v
        groups[v] = [name]
        out.append((F.col(v).cast("double") / (10.0 if v in tens else 1.0)).alias(name))
    return known.select(F.col(outcome).cast("double").alias("label"), *out), groups


def _standard(x: DataFrame, columns: list[str], extra: list[Column]) -> tuple[DataFrame, np.ndarray]:
    """(x, y, w) rows without nulls, columns scaled to mean 0 and deviation 1 behind a constant; the deviations."""
    clean = x.where(F.col("label").isNotNull()).dropna(subset=[f"`{c}`" for c in columns])
    facts = clean.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scale = np.array([facts[f"s{i}"] or 1.0 for i in range(len(columns))])
    scaled = [(F.col(f"`{c}`") - F.lit(facts[f"m{i}"] or 0.0)) / F.lit(float(scale[i])) for i, c in enumerate(columns)]
    rows = clean.select(F.array(F.lit(1.0), *scaled).alias("x"), F.col("label").cast("double").alias("y"), F.array(*extra).alias("w"))
    return cut_lineage(rows), scale


def adjusted_effects(x: DataFrame, groups: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(term, odds_ratio, ci_low, ci_high, p_value) and (variable, stat, dof, lrt_p): drop-one likelihood-ratio tests.

    The full model and the models without one variable are fitted together, a pass over the rows per step.
    """
    columns = [c for cols in groups.values() for c in cols]
    rows, scale = _standard(x, columns, [F.lit(1.0)])
    used = np.ones((1 + len(groups), 1 + len(columns)), bool)
    for i, cols in enumerate(groups.values()):
        used[i + 1, [1 + columns.index(c) for c in cols]] = False
    fit = fit_binary(rows, used, [0] * len(used))
    error = np.sqrt(np.diag(np.linalg.pinv(fit["hessian"][0])))[1:] / scale
    terms = [(c, math.exp(b), math.exp(b - 1.959963984540054 * e), math.exp(b + 1.959963984540054 * e), math.erfc(abs(b / e) / math.sqrt(2)))
             for c, b, e in zip(columns, (fit["beta"][0][1:] / scale).tolist(), error.tolist())]
    tests = [(v, 2 * float(fit["loss"][i + 1] - fit["loss"][0]), float(len(cols))) for i, (v, cols) in enumerate(groups.items())]
    spark = x.sparkSession
    lrt = spark.createDataFrame(tests, "variable string, stat double, dof double")
    return (spark.createDataFrame(terms, "term string, odds_ratio double, ci_low double, ci_high double, p_value double"),
            lrt.select("variable", "stat", "dof", chi2_tail(F.greatest("stat", F.lit(0.0)), F.col("dof")).alias("lrt_p")))


def stability_selection(x: DataFrame, groups: dict[str, list[str]], row_key: list[str], reps: int = 100, c: float = 0.05, seed: int = 42) -> DataFrame:
    """(variable, stability): share of half-samples in which an L1 model keeps the variable.

    All half-samples are fitted together. Key columns among the design are not used as variables.
    """
    columns = [col for cols in groups.values() for col in cols]
    key = F.xxhash64(*[F.col(f"`{k}`") for k in row_key])
    rows, _ = _standard(x, columns, [(draws.uniform(seed, F.lit(r), key) < 0.5).cast("double") for r in range(reps)])
    fit = fit_binary(rows, np.ones((reps, 1 + len(columns)), bool), range(reps), l1=1.0 / c, tolerance=1e-7)
    kept = np.abs(fit["beta"][:, 1:]) > 1e-8
    share = [(v, float(kept[:, [columns.index(col) for col in cols]].any(1).mean())) for v, cols in groups.items()]
    return x.sparkSession.createDataFrame(share, "variable string, stability double")


def permutation_importance(df: DataFrame, categorical: list[str], numeric: list[str], outcome: str, row_id: str, folds: int = 5, repeats: int = 10,
                           seed: int = 42, max_iter: int = 30) -> DataFrame:
    """(variable, perm_auc_drop, perm_ci_low, perm_ci_high): AUC lost on held-out folds when a column
    is shuffled. A shuffle pairs each row with the value at another hash position of the same fold."""
    known = df.where(F.col(outcome).isNotNull()).withColumn("label", F.col(outcome).cast("double")).withColumn("_fold", fold_of(seed, folds, F.col(row_id)))
    inputs = [f"_i_{c}" for c in categorical] + numeric
    filled = known.select(row_id, "label", "_fold", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical],
                          *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in numeric]).cache()
    index = StringIndexer(inputCols=categorical, outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep").fit(filled) if categorical else None
    ready = index.transform(filled) if index else filled
    assemble = VectorAssembler(inputCols=inputs, outputCol="_x")
    pieces = None
    for fold in range(folds):
        train, test = ready.where(F.col("_fold") != fold), ready.where(F.col("_fold") == fold)
        model = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=3, stepSize=0.1, maxIter=max_iter, seed=seed, maxBins=64).fit(assemble.transform(train))
        placed = {}
        for r in range(repeats):
            placed[r] = dense_index(test.select(row_id, *inputs).withColumn("_h", F.xxhash64(F.lit(seed), F.lit(r), F.col(row_id))), [F.col("_h"), F.col(row_id)], "_pos")
        still = dense_index(test.select(row_id, "label", *inputs).withColumn("_h", F.xxhash64(F.lit(seed), F.lit(-1), F.col(row_id))), [F.col("_h"), F.col(row_id)], "_pos")
        variants = [still.select("label", *inputs, F.lit("").alias("variable"), F.lit(-1).alias("rep"))]
        for r in range(repeats):
            for v, col in zip([*categorical, *numeric], inputs):
                swapped = still.drop(col).join(placed[r].select("_pos", col), "_pos")
                variants.append(swapped.select("label", *inputs, F.lit(v).alias("variable"), F.lit(r).alias("rep")))
        stacked = variants[0]
        for v in variants[1:]:
            stacked = stacked.unionByName(v)
        scored = model.transform(assemble.transform(stacked)).select("label", "variable", "rep", F.round(vector_to_array("probability")[1], 6).alias("p"))
        fold_auc = auc(scored, "p", "label", ["variable", "rep"]).withColumn("fold", F.lit(fold))
        pieces = fold_auc if pieces is None else pieces.unionByName(fold_auc)
    base = pieces.where("rep = -1").select("fold", F.col("auc").alias("base"))
    drops = pieces.where("rep >= 0").join(base, "fold").select("variable", (F.col("base") - F.col("auc")).alias("d"))
    return drops.groupBy("variable").agg(F.avg("d").alias("perm_auc_drop"), F.percentile("d", F.lit(0.025)).alias("perm_ci_low"), F.percentile("d", F.lit(0.975)).alias("perm_ci_high"))


def evidence_tiers(uni: DataFrame, lrt: DataFrame, stability: DataFrame, permutation: DataFrame) -> DataFrame:
    """One row per variable: votes of three lines of evidence, tier and consensus rank."""
    tested = benjamini_hochberg(lrt, "lrt_p", ["variable"], "lrt_q")
    joined = uni.join(permutation, "variable").join(tested, "variable").join(stability, "variable")
    votes = (F.col("lrt_q") < 0.05).cast("int") + (F.col("stability") >= 0.6).cast("int") + (F.col("perm_ci_low") > 0).cast("int")
    voted = joined.withColumn("evidence_votes", votes).withColumn(
        "evidence_tier", F.when(votes == 3, "confirmed").when(votes == 2, "supported").otherwise("not supported"))
    return consensus_rank(voted, ["q_value", "lrt_p"], ["stability", "perm_auc_drop"])


def discover(df: DataFrame, categorical: list[str], numeric: list[str], outcome: str, row_id: str, reps: int = 100, folds: int = 5, repeats: int = 10, seed: int = 42) -> DataFrame:
    """The evidence table of all variables, best first."""
    x, groups = design(df, categorical, numeric, outcome)
    _, lrt = adjusted_effects(x, groups)
    keyed, _ = design(df.withColumn("_rid", F.xxhash64(row_id).cast("double")), categorical, [*numeric, "_rid"], outcome)
    stable = stability_selection(keyed, groups, ["_rid"], reps, seed=seed)
    importance = permutation_importance(df, categorical, numeric, outcome, row_id, folds, repeats, seed)
    return evidence_tiers(univariate(df, categorical, numeric, outcome), lrt, stable, importance).orderBy("consensus_rank", "variable")
