"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_minimum(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them; a hub is only ever aggregated."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(low, "u")
    chosen = joined.filter(F.col("v") > F.col("u")) if keep_larger else joined.filter(F.col("v") != F.col("m"))
    moved = chosen.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not keep_larger:
        moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of longs to (node, root): root is the smallest node reached; no order assumed.

    Rounds end when a round changes nothing. Each round's table is written, so a lost executor
    costs one round. No links: no rows.
    """
    links = cut(edges.filter("u <> v").select("u", "v").distinct())
    stars = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, True)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = cut(_to_minimum(down, False))
        before, after = (t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for t in (stars, small))
        stars = small
        if before == after:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
