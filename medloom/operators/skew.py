"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

HEAVY_KEYS = 1024
BROADCAST_ROWS = 200_000


def lookup(left: DataFrame, dim: DataFrame, key: str, values: list[str], weight: str, spread: Column) -> DataFrame:
    """Left-join ``dim`` (unique on ``key``) to a skewed ``left`` in one pass.

    The ``HEAVY_KEYS`` keys of largest ``weight`` are broadcast, a fixed number of rows whatever
    the data. Rows served that way carry a spread-out key that meets nothing in the shuffled
    join, so no task receives a whole hot key.
    """
    ranked = dim.select(key, *values, weight).orderBy(F.col(weight).desc(), key)
    heavy = ranked.limit(HEAVY_KEYS).select(
        F.col(key), *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_served")
    )
    step = left.join(F.broadcast(heavy), key, "left")
    if dict(left.dtypes)[key] == "string":
        free = F.concat(F.lit("\u0000"), (F.xxhash64(spread) % 4096).cast("string"))
    else:
        free = -1 - F.pmod(F.xxhash64(spread), F.lit(4096))
    step = step.withColumn("_k", F.when(F.col("_served"), free).otherwise(F.col(key)))
    rest = dim.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_l_{v}") for v in values])
    joined = step.join(rest, "_k", "left")
    merged = [
        F.when(F.col("_served"), F.col(f"_h_{v}")).otherwise(F.col(f"_l_{v}")).alias(v) for v in values
    ]
    return joined.select(*left.columns, *merged)


MASKS = 1 << 19  # of 64 bits, the rows of a bitmap at most


def _masks(dim: DataFrame, key: str) -> DataFrame:
    place = F.xxhash64(key)
    slots = dim.select(place.bitwiseAND(F.lit(MASKS - 1)).alias("_slot"), F.shiftrightunsigned(place, 58).cast("int").alias("_bit"))
    return slots.groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_mask"))


def maybe_known(left: DataFrame, dim: DataFrame, key: str, known: bool = True) -> DataFrame:
    """``left`` without most rows whose ``key`` is not in ``dim``; none that is in it is left out.

    The keys' hashes set bits of one bitmap of bounded size, which is broadcast, so that rows that meet
    nothing need not be shuffled. Rows that pass may still meet nothing. With ``known`` false it returns
    all other rows, which surely are not in ``dim``.
    """
    place = F.xxhash64(key)
    placed = left.select("*", place.bitwiseAND(F.lit(MASKS - 1)).alias("_slot"), F.shiftrightunsigned(place, 58).cast("int").alias("_bit"))
    met = placed.join(F.broadcast(_masks(dim, key)), "_slot", "inner" if known else "left")
    return met.where("getbit(_mask, _bit) = 1" if known else "_mask IS NULL OR getbit(_mask, _bit) = 0").select(*left.columns)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def guarded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; larger sides keep the shuffle join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input comes in fewer splits than there are cores.

    Meant for work that is heavy per row, such as text. A large input has more splits than cores and
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Global 0-based position by ``order`` without a one-partition window.

    Range sort, materialise, then add per-partition offsets; the offset table has one row per
    partition. Ties beyond ``order`` share no position, so ``order`` should be total.
    """
    placed = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mono")
    )
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_skip") + F.col("_mono") - F.col("_first"))
        .drop("_part", "_mono", "_first", "_skip")
    )


def expand_copies(df: DataFrame, count: str, number: str, chunk: int = 1_000_000) -> DataFrame:
    """Repeat each row ``count`` times, numbered from 1, with no task making a whole hot group."""
    few = df.where(F.col(count) <= chunk).withColumn(
        number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))
    )
    many = (
        df.where(F.col(count) > chunk)
        .withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count), F.lit(chunk).cast("long"))))
        .repartition("_from", *[c for c in df.columns if c != count])
        .withColumn(number, F.explode(F.sequence(
            F.col("_from"), F.least(F.col("_from") + chunk - 1, F.col(count)))))
        .drop("_from")
    )
    return few.unionByName(many)
