"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source weights are token shares raised to one exponent and normalised. The exponent is found by
bisection, either for a target entropy of the weights or so that no source is repeated more than a
limit. The budget of tokens is then spent: each source gives whole passes over its documents and a
part of a last one, each pass in an order of its own, and the passes of all sources are laid over
one line of blocks so that every block holds the sources in their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pieces, text_of

LEVELS = 4  # bisection steps taken by one pass over the source table: 2**4 - 1 exponents side by side
PASSES = 10  # 40 halvings: the exponent is known to 1e-12
BUCKET_ROWS = 20_000  # documents ordered by one task at a time
BLOCK_TOKENS = 1 << 20
REPEATS = 1.25  # passes over a source at most


def token_count(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")).cast("long")


def draw(seed: int, *parts: Column) -> Column:
    """60 bits of a keyed digest: the same in any engine that has MD5."""
    line = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _weights(sources: DataFrame, exponent: Column | float) -> DataFrame:
    """Adds log weights for exponents in column or value ``e``: tokens**e / sum(tokens**e)."""
    e = exponent if isinstance(exponent, Column) else F.lit(exponent)
    return sources.withColumn("e", e).withColumn("p", F.exp(F.col("e") * F.log(F.col("share"))))


def _measure(sources: DataFrame, exponents: list[float], target: str, budget: float) -> dict[float, float]:
    """Entropy of the weights, or largest number of passes over a source, for each exponent."""
    rows = _weights(sources, F.explode(F.array(*[F.lit(x) for x in exponents])))
    if target == "entropy":
        total = rows.groupBy("e").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("s"))
        found = total.select("e", (F.log("z") - F.col("s") / F.col("z")).alias("v"))
    else:
        total = rows.groupBy("e").agg(F.sum("p").alias("z"), F.max(F.col("p") / F.col("tokens")).alias("m"))
        found = total.select("e", (F.col("m") / F.col("z") * F.lit(budget)).alias("v"))
    return {r["e"]: r["v"] for r in found.collect()}  # one number per exponent


def solve(sources: DataFrame, budget: float, entropy: float | None = None, repeats: float = REPEATS) -> float:
    """Exponent in [0, 1]: 0 weighs all sources alike, 1 leaves their shares.

    Entropy and passes both fall as the exponent grows. With ``entropy`` (in nats) the weights have
    that entropy, or come as near as [0, 1] allows; without it, the smallest exponent is taken that
    keeps every source within ``repeats`` passes (1 if none does).
    """
    target, goal = ("entropy", entropy) if entropy is not None else ("repeats", repeats)
    low, high = 0.0, 1.0
    ends = _measure(sources, [low, high], target, budget)
    if not ends or ends[low] <= goal:
        return low
    if ends[high] >= goal:
        return high
    for _ in range(PASSES):
        grid = [low + (high - low) * i / 2**LEVELS for i in range(2**LEVELS + 1)]
        value = _measure(sources, grid[1:-1], target, budget)
        a, b = 0, 2**LEVELS
        for _ in range(LEVELS):
            middle = (a + b) // 2
            a, b = (middle, b) if value[grid[middle]] > goal else (a, middle)
        low, high = grid[a], grid[b]
    return round(high, 9)


def plan(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float = REPEATS) -> tuple[DataFrame, DataFrame, float]:
    """Documents with tokens, sources with tokens, share, weight and budget, and the exponent."""
    counted = cut(docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(text_of()).alias("tokens")))
    by_source = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = counted.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    tokens = total["t"] or 0
    spend = tokens if budget is None else budget
    sources = cut(by_source.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(tokens, 1)))))
    exponent = solve(sources, float(spend), entropy, repeats)
    powered = _weights(sources, exponent)
    z = powered.agg(F.sum("p").alias("z")).first()["z"] or 1.0
    sources = cut(powered.select("source", "tokens", "n_docs", "share", (F.col("p") / F.lit(z)).alias("weight")).withColumn("budget", F.floor(F.col("weight") * F.lit(float(spend))).cast("long")))
    return counted, sources, exponent


def block_permutations(counted: DataFrame, sources: DataFrame, seed: int = 0, bucket_rows: int = BUCKET_ROWS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, pass_no, tokens, block, position.

    A source's pass orders its documents by a keyed draw. The order is cut into buckets of bounded
    rows; a document's place in tokens is the sum of the buckets before it and of the rows before it
    in its bucket, so no task sees a whole source. A document belongs to the mix if its place in the
    pass line of its source lies before the budget. Its place divided by the budget, the same scale
    for all sources, names its block.
    """
    passes = F.ceil(F.col("budget") / F.col("source_tokens"))
    size = sources.select(F.col("source"), F.col("tokens").alias("source_tokens"), "n_docs", "budget").filter("budget > 0")
    rows = counted.join(size, "source").withColumn("pass_no", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))
    buckets = F.greatest(F.ceil(F.col("n_docs") / bucket_rows), F.lit(1)).cast("long")
    rows = rows.withColumn("key", draw(seed, F.col("source"), F.col("pass_no"), F.col("doc_id")))
    rows = rows.withColumn("bucket", F.floor(F.col("key") / F.lit(2.0**60) * buckets).cast("long"))
    each = rows.groupBy("source", "pass_no", "bucket").agg(F.sum("tokens").alias("t"))
    ahead = Window.partitionBy("source", "pass_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("source", "pass_no", "bucket", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "pass_no", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(each, ["source", "pass_no", "bucket"])
    placed = placed.withColumn("place", F.col("pass_no") * F.col("source_tokens") + F.col("ahead") + F.col("inside"))
    taken = placed.filter(F.col("place") < F.col("budget"))
    spend = sources.agg(F.sum("budget").alias("b")).first()["b"] or 0
    blocks = pieces(int(spend), block_tokens)
    taken = taken.withColumn("block", F.floor(F.col("place") / F.col("budget") * F.lit(blocks)).cast("long"))
    order = Window.partitionBy("block").orderBy(draw(seed + 1, F.col("block"), F.col("source"), F.col("pass_no"), F.col("doc_id")), "source", "pass_no", "doc_id")
    return taken.select("doc_id", "source", F.col("pass_no").cast("int").alias("pass_no"), "tokens", "block", F.row_number().over(order).alias("position"))


def mix_sources(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float = REPEATS, seed: int = 0) -> DataFrame:
    """One row per use of a document: doc_id, source, pass_no, tokens, block, position.

    A null source counts as the empty name, null text as empty; documents without tokens take no
    budget and come with the pass they fall in. Sources without tokens are not used. The budget
    defaults to the tokens there are. No documents: no rows.
    """
    counted, sources, _ = plan(docs, budget, entropy, repeats)
    return block_permutations(counted, sources, seed)


def mixed_documents(docs: DataFrame, budget: int | None = None, entropy: float | None = None, repeats: float = REPEATS, seed: int = 0) -> DataFrame:
    """Rows of ``docs`` as often as the mix uses them, all columns as they came.

    Rows without doc_id are drawn together: each of them is used as often as the first.
    """
    uses = mix_sources(docs, budget, entropy, repeats, seed).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"))
    uses = uses.groupBy("__id", "__source").agg(F.count(F.lit(1)).alias("__n"))
    same = docs.groupBy(F.col("doc_id").alias("__same_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__same_source")).agg(F.count(F.lit(1)).alias("__copies"))
    uses = uses.join(same, F.col("__id").eqNullSafe(F.col("__same_id")) & (F.col("__source") == F.col("__same_source")))
    times = uses.select("__id", "__source", F.ceil(F.col("__n") / F.col("__copies")).cast("int").alias("__times"))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(F.col("__id")) & (source == F.col("__source")))
    repeated = joined.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*[docs[c] for c in docs.columns])
