"""Target-distribution importance resampling over hashed word features.

Word runs fall into a fixed number of buckets. A bucket's gain is the log ratio of its shares in the
target and in the corpus, a document's weight the mean gain of its features. With a keyed Gumbel draw
added, the highest scores are a sample without replacement in proportion to the weights.

The gains are one array of fixed length. The scores are written; the cutoff is found by bisection on
their number range, with exact counts over the written table, then on doc_id among the rows tied at
the cutoff. Ranks come from a range partition of the drawn rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medloom.operators.skew import expand_copies

from .common import cut, text_of
from .runs import joined_runs, text_bytes, word_lists

BUCKETS = 10_000
RUNS = 1  # features are runs of 1 to RUNS words
SCALE = 1000  # gains and draws are whole thousandths
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
FAN = 15  # thresholds counted by one job

# Fixed by the word rule: A-Z become lower case; of the ASCII characters only letters and digits belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def feature_buckets(data: bytes, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them), for a text piece by piece."""
    seen = 0
    for words in word_lists(data.translate(_FOLD), runs - 1):
        carried = min(seen, runs - 1)
        found = []
        for size in range(1, runs + 1):
            own = words[max(0, carried - size + 1) :]  # runs that end in a new word
            if len(own) >= size:
                found += [crc32(x) for x in joined_runs(own, size)]
        seen += len(words) - carried
        yield len(words) - carried, np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: one array of ``buckets`` numbers, added up in the tasks first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in text_bytes(batch["text"]):
                for _, found in feature_buckets(data, runs, buckets):
                    if len(found):
                        sums += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    parts = texts.select(text_of().alias("text")).mapInArrow(task, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole gain of each bucket, both sides smoothed by one feature per bucket."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = lambda s, t: ((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(doc_id, digest, n_words, n_features, weight): weight is the floored mean gain of the features."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in text_bytes(batch["text"]):
                words = features = total = 0
                for new, found in feature_buckets(data, runs, len(gain)):
                    words, features, total = words + new, features + len(found), total + int(gain[found].sum())
                rows.append((words, features, total // features if features else 0))
            numbers = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["digest"], *(pa.array(numbers[:, i]) for i in range(3))], ["doc_id", "digest", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(task, "doc_id long, digest long, n_words long, n_features long, weight long")


def gumbel(seed: int, key: Column) -> Column:
    """Whole thousandths of a Gumbel draw from 32 bits of a keyed SHA-256."""
    line = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(line, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def lowest_reaching(rows: DataFrame, key: Column, need: int) -> int | None:
    """Smallest whole number t for which rows with ``key`` <= t have ``need`` copies, by bisection.

    Every job counts all rows exactly, at up to ``FAN`` thresholds. None if there are too few rows.
    """
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum("n").alias("n")).first()
    if ends["lo"] is None or ends["n"] < need:
        return None
    low, high = ends["lo"] - 1, ends["hi"]  # too few at low, enough at high
    while high - low > 1:
        steps = min(FAN, high - low - 1)
        at = [low + (high - low) * (i + 1) // (steps + 1) for i in range(steps)]
        found = rows.agg(*[F.sum(F.when(key <= F.lit(t), F.col("n")).otherwise(0)).alias(f"c{i}") for i, t in enumerate(at)]).first()
        for t, c in zip(at, found):
            low, high = (max(low, t), high) if c < need else (low, min(high, t))
    return high


def _ranked(chosen: DataFrame, need: int) -> DataFrame:
    """Adds ``upto``: copies up to and including the row, by falling score, then doc_id, nulls last."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("digest")]
    parts = max(chosen.sparkSession.sparkContext.defaultParallelism, math.ceil(need / 500_000))
    placed = cut(chosen.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    skips = placed.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("skip"))
    return placed.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(skips), "part").withColumn("upto", F.col("upto") + F.col("skip")).drop("part", "skip")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest of the text, n_words, n_features, weight, score, rank.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn: the highest
    scores, ties to the smaller doc_id, rank 1 first; the others have no rank. Null text counts as
    empty, a row without features has weight 0. Rows without doc_id share one draw and come last among
    ties; rows of one doc_id and score follow by weight, then digest. Equal rows are counted together and ranked one after another; if only some of them can be
    drawn, the rest have no rank. An empty target leaves a gain by the corpus alone. Other columns of
    ``docs`` are not read. No documents: no rows.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = weigh(docs, gain, runs).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id")))
    same = ["doc_id", "digest", "n_words", "n_features", "weight", "score"]
    rows = cut(scored.groupBy(*same).agg(F.count(F.lit(1)).alias("n")))
    able = rows.filter(F.col("n_words") >= least_words)
    need = percent * (able.agg(F.sum("n").alias("n")).first()["n"] or 0) // 100
    falls = -F.col("score")
    at = lowest_reaching(able, falls, need) if need else None
    if at is None:
        drawn = F.lit(False)
    else:
        tied = able.filter(falls == at)
        ties = need - (able.filter(falls < at).agg(F.sum("n").alias("n")).first()["n"] or 0)
        last = lowest_reaching(tied.filter("doc_id IS NOT NULL"), F.col("doc_id"), ties)
        within = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(False))  # too few ids: rows without one come too
        drawn = (F.col("n_words") >= least_words) & ((falls < at) | ((falls == at) & within))
    copies = expand_copies(rows.filter(~drawn), "n", "copy").select(*same, F.lit(None).cast("long").alias("rank"))
    taken = expand_copies(_ranked(rows.filter(drawn), need), "n", "copy")
    place = F.col("upto") - F.col("n") + F.col("copy")
    return copies.unionByName(taken.select(*same, F.when(place <= need, place).cast("long").alias("rank")))


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they came; copies of a row at the cutoff come together."""
    drawn = resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__digest"))
    return docs.join(drawn, same, "left_semi")
