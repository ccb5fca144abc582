"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of a whole text in Arrow batches. The trees are grown on
quantile-binned statistics of a bounded sample of labelled rows, then flattened into arrays; a batch
is scored by walking all its rows down one tree level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import string_batches, text_of, word_hashes

SAMPLE = 20_000  # labelled rows fitted at most: the driver holds rows x statistics numbers
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
MIN_ROWS = 10
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "top_word", "repeats_previous", "repeats_bigram",
    "upper", "digit", "space", "line_break", "punctuation", "symbol", "non_ascii", "pipe", "exclamation",
    "symbol_end_words", "upper_words", "one_letter_words", "long_words", "mean_line", "distinct_lines",
    "stop_end_lines", "distinct_bytes", "byte_entropy", "run_share",
)


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[65:91] = 1
    kind[48:58] = 2
    for c in b".,;:'\"()?-":
        kind[c] = 3
    for c in b"#$%&*@^~<>=+_\\/{}[]`":
        kind[c] = 4
    kind[128:] = 5
    kind[ord("|")] = 6
    kind[ord("!")] = 7
    return kind


_KIND = _classes()


def _row_sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct values, and count of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(values):
        order = np.lexsort((values, rows))
        v, r = values[order], rows[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(v)))
        distinct = np.bincount(r[at], minlength=n).astype(float)
        np.maximum.at(top, r[at], size)
    return distinct, top


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x statistics of raw UTF-8 texts; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    per_byte = 1 / np.maximum(size, 1)
    flat = np.where((buf == 10) | (buf == 9) | (buf == 13), np.uint8(32), buf)
    words, first, b, e = word_hashes(flat, offsets)
    count = np.diff(first).astype(float)
    per_word = 1 / np.maximum(count, 1)
    rows = np.repeat(np.arange(n), np.diff(first))
    length = (e - b).astype(float)
    distinct, top = _distinct(words, rows, n)
    pair = np.zeros(len(words), bool)
    pair[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    big = words * np.uint64(3) + np.roll(words, -1)
    inner = np.zeros(len(words), bool)
    inner[:-1] = rows[1:] == rows[:-1]
    pairs, _ = _distinct(big[inner], rows[inner], n)
    kind = _KIND[buf]
    share = [_row_sums(kind == k, offsets) * per_byte for k in range(8)]
    last = kind[e - 1] if len(e) else np.zeros(0, np.uint8)
    head = kind[b] if len(b) else np.zeros(0, np.uint8)
    second = kind[np.minimum(b + 1, len(buf) - 1)] if len(b) else head
    breaks = _row_sums(buf == 10, offsets).astype(float)
    # lines: fold words between breaks into one hash each
    lines, stops, seen = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(words):
        cuts = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(buf == 10, out=cuts[1:])
        line = cuts[b] + rows  # rows added, as texts follow each other without a break
        start = np.ones(len(words), bool)
        start[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(start)
        place = (np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))).astype(np.uint64)
        folded = np.add.reduceat(words * (place * np.uint64(2) + np.uint64(1)), at)
        owner = rows[at]
        lines = np.bincount(owner, minlength=n).astype(float)
        ends = np.append(at[1:], len(words)) - 1
        stops = np.bincount(owner, weights=last[ends] == 3, minlength=n)
        seen, _ = _distinct(folded, owner, n)
    byte_rows = np.repeat(np.arange(n), np.diff(offsets))
    table = np.bincount(byte_rows * 256 + buf, minlength=n * 256).reshape(n, 256)
    p = table * per_byte[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    same = np.zeros(len(buf), bool)
    same[1:] = buf[1:] == buf[:-1]
    columns = [
        np.log1p(size), np.log1p(count), np.bincount(rows, weights=length, minlength=n) * per_word, distinct * per_word,
        top * per_word, np.bincount(rows, weights=pair, minlength=n) * per_word, 1 - pairs / np.maximum(count - 1, 1),
        share[1], share[2], _row_sums(flat == 32, offsets) * per_byte, breaks * per_byte, share[3], share[4], share[5], share[6], share[7],
        np.bincount(rows, weights=(last == 4) | (last == 7), minlength=n) * per_word,
        np.bincount(rows, weights=(head == 1) & (second == 1) & (length > 1), minlength=n) * per_word,
        np.bincount(rows, weights=length == 1, minlength=n) * per_word, np.bincount(rows, weights=length > 15, minlength=n) * per_word,
        size / np.maximum(lines, 1), seen / np.maximum(lines, 1), stops / np.maximum(lines, 1),
        (table > 0).sum(1).astype(float), entropy, _row_sums(same, offsets) * per_byte,
    ]
    out = np.stack(columns, 1)
    out[size == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """All trees as arrays of nodes: a leaf points to itself, so a walk may go on past it."""

    edges: np.ndarray  # statistics x BINS - 1
    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], "left") for j in range(x.shape[1])], 1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, at, total = self.binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                goes = bins[at, self.feature[t, node]] <= self.cut[t, node]
                node = np.where(goes, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; every split is read off bin histograms."""
    if not len(y):
        x, y = np.zeros((1, x.shape[1] if x.ndim == 2 else len(STATISTICS))), np.array([0.5])
    n, m = x.shape
    quantiles = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    model = Trees(quantiles, 0.0, *(np.zeros((0, 1), np.int32) for _ in range(5)), depth)
    b = model.binned(x)
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(n, base)
    nodes = 2 ** (depth + 1) - 1
    arrays = {k: np.zeros((trees, nodes), np.int32) for k in ("feature", "cut", "left", "right")}
    value = np.zeros((trees, nodes))
    flat = b.astype(np.int64) + np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        arrays["left"][t] = arrays["right"][t] = np.arange(nodes)
        value[t, 0] = rate * g.sum() / (h.sum() + ridge)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 2 * MIN_ROWS:
                    continue
                index = flat[own].ravel()
                hist = [np.bincount(index, weights=np.repeat(w, m), minlength=m * bins).reshape(m, bins).cumsum(1) for w in (g[own], h[own], np.ones(len(own)))]
                gl, hl, nl = hist
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = -1
                j, c = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, c] <= 1e-6:
                    continue
                arrays["feature"][t, k], arrays["cut"][t, k] = j, c
                arrays["left"][t, k], arrays["right"][t, k] = 2 * k + 1, 2 * k + 2
                goes = b[own, j] <= c
                node[own] = np.where(goes, 2 * k + 1, 2 * k + 2)
                for child, side in ((2 * k + 1, own[goes]), (2 * k + 2, own[~goes])):
                    value[t, child] = rate * g[side].sum() / (h[side].sum() + ridge)
        raw += value[t, node]
    return Trees(quantiles, base, **arrays, value=value, depth=depth)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _statistic_batches(batches):
    for batch in batches:
        text = batch.column("text")
        rows = [statistics(buf, offsets) for _, _, buf, offsets in string_batches(text)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
        values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), values], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows outside the held-out quarter, picked by id hash.

    A doc_id with two labels takes the smaller one; null labels and null ids are left out.
    """
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    found = rows.select(F.col("quality").cast("double"), "text").mapInArrow(_statistic_batches, "quality double, x array<double>").toPandas()
    x = np.array(found["x"].tolist()).reshape(len(found), len(STATISTICS))
    order = np.lexsort((found["quality"].to_numpy(), *x.T))  # the same trees in any layout
    return grow(x[order], found["quality"].to_numpy(float)[order])


def _score_batches(model: Trees, kept: list[str]):
    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            scores = [model.score(statistics(buf, offsets)) for _, _, buf, offsets in string_batches(text)]
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), score], names=[*kept, "__score"])

    return run


def with_score(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` and a column ``__score``: the chance of a good text, for null and empty texts too."""
    schema = docs.select("*", F.lit(0.0).alias("__score")).schema
    return docs.mapInArrow(_score_batches(model, docs.columns), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row; repeated rows repeat, a null doc_id is not held out."""
    scored = with_score(docs.select(F.col("doc_id"), "text"), fit(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text scores at least ``threshold``, all columns as they came."""
    scored = with_score(docs, fit(docs, labels, sample))
    return scored.filter(F.col("__score") >= threshold).drop("__score")
