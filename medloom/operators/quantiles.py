"""Exact order statistics of many columns, groups and ranks at once, in two scans.

The first scan sketches brackets around all ranks. The second counts, for every bracket, the rows below
it and each distinct value inside it; positions inside come from a range sort, so no task holds a
column. A bracket that missed its rank is widened and tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FEW = 10_000  # up to so many values the bracket is the whole column: sketches of few values name neighbours
WIDTH = 5e-4  # of a bracket to either side, as a share of the rows; the sketch errs by a fifth of it
ACCURACY = 10_000


def order_values(df: DataFrame, columns: list[str], positions: list[tuple[float, Column]], group: list[str] | None = None) -> DataFrame:
    """(group, column, i, n, value): the value at position i of each column's non-null values in rising order.

    A position is its approximate share of the rows and its exact 0-based place as an expression of the
    count ``n``; places between two rows interpolate linearly, places outside give null. Groups and
    columns without values have no row.
    """
    from .association import cumulative

    key = [*(group or []), "column"]
    long = df.select(*(group or []), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e"))
    long = long.select(*(group or []), "e.*").where("v IS NOT NULL")
    done, width, ask = None, WIDTH, list(range(len(positions)))
    while ask:
        edges = [x for i in ask for x in (max(0.0, positions[i][0] - width), min(1.0, positions[i][0] + width))]
        facts = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", edges, ACCURACY).alias("e"))
        side = lambda k, end: F.when((F.col("n") <= FEW) | F.lit(width >= 1), F.col(end)).otherwise(F.col("e")[k])  # noqa: B023, E731
        asked = F.array(*[F.struct(F.lit(i).alias("i"), side(2 * k, "least").alias("lo"), side(2 * k + 1, "most").alias("hi")) for k, i in enumerate(ask)])
        targets = cut_lineage(facts.select(*key, "n", asked.alias("t")))
        mark = F.transform("t", lambda t: F.when(F.col("v") <= t["hi"], F.struct(t["i"].alias("i"), F.when(F.col("v") >= t["lo"], F.col("v")).alias("v"))))
        cells = long.join(targets.select(*key, "t"), key).select(*key, F.explode(F.filter(mark, lambda m: m.isNotNull())).alias("m")).select(*key, "m.*")
        cells = cut_lineage(cells.groupBy(*key, "i", "v").agg(F.count(F.lit(1)).alias("c")))
        under = cells.where("v IS NULL").select(*key, "i", F.col("c").alias("under"))
        placed = cumulative(cells.where("v IS NOT NULL"), [*key, "i"], "v", ["c"]).join(under, [*key, "i"], "left").join(targets.select(*key, "n"), key)
        at = F.element_at(F.array(*[x.cast("double") for _, x in positions]), F.col("i") + 1)
        first = F.coalesce("under", F.lit(0)) + F.col("before_c")
        holds = lambda r: F.max(F.when((first <= r) & (r < first + F.col("c")), F.col("v")))
        found = placed.withColumn("at", at).groupBy(*key, "i", "n", "at").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"))
        inside = (F.col("at") >= 0) & (F.col("at") <= F.col("n") - 1)
        value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
        found = cut_lineage(found.select(*key, "i", "n", F.when(inside, value).alias("value"), (inside & (F.col("a").isNull() | F.col("b").isNull())).alias("missed")))
        missed = {r["i"] for r in found.where("missed").select("i").distinct().collect()}  # positions, not rows
        part = found.where(~F.col("i").isin(sorted(missed))) if missed else found
        done = part if done is None else done.unionByName(part)
        ask, width = sorted(missed), width * 8
    return done.select(*key, "i", "n", "value")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], group: list[str] | None = None) -> DataFrame:
    """(group, column, i, n, value) for the i-th share, interpolated between neighbouring order statistics."""
    return order_values(df, columns, [(q, (F.col("n") - 1) * F.lit(float(q))) for q in shares], group)


def order_statistic(df: DataFrame, column: str, rank: int) -> float | None:
    """The value at 0-based ``rank`` of the non-null values in ascending order."""
    total = df.where(F.col(column).isNotNull()).count()
    if not 0 <= rank < total:
        return None
    return order_values(df, [column], [((rank + 0.5) / total, F.lit(rank))]).first()["value"]


def quantile(df: DataFrame, column: str, q: float) -> float | None:
    row = quantiles(df, [column], [q]).first()
    return row["value"] if row else None


def rank_at(share: float) -> tuple[float, Column]:
    """Position floor(share * n)."""
    return share, F.floor(F.lit(share) * F.col("n"))

