"""Benchmark passages in documents by SimHash of item-sized windows.

Every window of an item's length slides over a text; its 128-bit fingerprint is a difference of
running sums of signed shingle weights. A window within Hamming radius 38 of an item agrees with it
to within 4 bits in one of eight 16-bit blocks (38 < 8 x 5), so looking at blocks first loses none.
What remains is decided by the exact weighted Jaccard similarity of the two shingle multisets.

Windows that share no shingle with an item of their length have similarity 0 and are passed over
before any fingerprint is made. The benchmark is read in blocks of bounded bytes, and each block
passes over all documents.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, mix, pieces, shingle_hashes, string_batches, text_of, total_bytes, word_hashes, words_of

THRESHOLD = 0.8
RADIUS = 38  # of 128 bits; at similarity 0.8 the distance is 19 bits with a deviation of 4
BLOCKS = 8
BENCHMARK_BYTES = 4 << 20  # of items shipped to the tasks at a time
RUN = 1 << 14  # windows in memory at a time
_FLAG_BITS = 20
_BITS16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _signs(h: np.ndarray) -> np.ndarray:
    """Shingles x 128 of +1 and -1."""
    two = np.stack([mix(h + np.uint64(1)), mix(h ^ np.uint64(0x9E3779B97F4A7C15))], 1)
    return np.unpackbits(two.view(np.uint8).reshape(len(h), 16), axis=1).astype(np.float64) * 2 - 1


def _blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as eight 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


@dataclass
class Items:
    """Benchmark items that share a shingle size, ready for one pass."""

    size: int
    ids: list = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)  # in text order, repeats kept
    hashes: np.ndarray = None
    weights: np.ndarray = None
    top: float = 1.0
    flags: np.ndarray = None
    by_length: dict = field(default_factory=dict)  # shingle count -> item numbers
    lengths_of: dict = field(default_factory=dict)  # shingle -> shingle counts of items that hold it

    def finish(self) -> "Items":
        df = Counter(h for s in self.shingles for h in set(s.tolist()))
        self.hashes = np.array(sorted(df), np.uint64)
        n = len(self.ids)
        self.top = float(np.rint(1024 * np.log1p(n)))
        self.weights = np.array([np.rint(1024 * np.log1p(n / df[int(h)])) for h in self.hashes])
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[(self.hashes >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True
        lengths, groups = defaultdict(set), defaultdict(list)
        for i, s in enumerate(self.shingles):
            groups[len(s)].append(i)
            for h in set(s.tolist()):
                lengths[h].add(len(s))
        self.lengths_of = dict(lengths)
        for length, numbers in groups.items():
            prints = np.concatenate([_blocks((_signs(self.shingles[i]) * self.weigh(self.shingles[i])[:, None]).sum(0, keepdims=True)) for i in numbers])
            self.by_length[length] = (numbers, prints)
        return self

    def weigh(self, h: np.ndarray) -> np.ndarray:
        """log(1 + items / items with the shingle), in 1,024ths so that sums are exact.

        A shingle of no item weighs as if one had it.
        """
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], self.top)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.flags[(h >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == h[maybe]]


def build(items: list[tuple], shingle: int = SHINGLE) -> list[Items]:
    """Items by shingle size: an item with fewer words than a shingle is one shingle of all of them."""
    out: dict[int, Items] = {}
    for item_id, words in items:
        column = pa.array([words], pa.string())
        for _, _, buf, offsets in string_batches(column):
            w, first, _, _ = word_hashes(buf, offsets)
            if len(w):
                size = min(shingle, len(w))
                group = out.setdefault(size, Items(size))
                group.ids.append(item_id)
                group.shingles.append(shingle_hashes(w, first, size)[0])
    return [g.finish() for _, g in sorted(out.items())]


def _similarity(window: np.ndarray, item: np.ndarray, items: Items) -> float:
    a, b = Counter(window.tolist()), Counter(item.tolist())
    keys = np.array(list(a.keys() | b.keys()), np.uint64)
    w = items.weigh(keys)
    x, y = (np.array([c[int(k)] for k in keys]) for c in (a, b))
    return float((w * np.minimum(x, y)).sum() / (w * np.maximum(x, y)).sum())


def _starts(anchors: np.ndarray, length: int, n: int) -> np.ndarray:
    if n <= length:
        return np.zeros(1, np.int64)
    near = (anchors[:, None] - np.arange(length)[None, :]).ravel()
    return np.unique(np.clip(near, 0, n - length))


def matches(h: np.ndarray, anchors: np.ndarray, items: Items, radius: int, threshold: float) -> dict:
    """Best window per item over one text: item number -> (similarity, distance, start, shingles)."""
    wanted = defaultdict(list)
    for p in anchors:
        for length in items.lengths_of[int(h[p])]:
            wanted[length].append(p)
    best: dict[int, tuple] = {}
    for length, at in wanted.items():
        numbers, prints = items.by_length[length]
        all_starts = np.unique(np.concatenate([_starts(np.array(at[i : i + 4096]), length, len(h)) for i in range(0, len(at), 4096)]))
        span = min(length, len(h))
        # runs of windows that overlap, at most RUN of them together
        new = np.flatnonzero(np.diff(all_starts) > span) + 1
        bounds = np.unique(np.concatenate([[0], new, np.arange(0, len(all_starts), RUN), [len(all_starts)]]))
        for i, j in zip(bounds[:-1], bounds[1:]):
            starts = all_starts[i:j]
            part = h[starts[0] : starts[-1] + span]
            sums = np.zeros((len(part) + 1, 128))
            np.cumsum(_signs(part) * items.weigh(part)[:, None], axis=0, out=sums[1:])
            at0 = starts - starts[0]
            own = _blocks(sums[at0 + span] - sums[at0])
            step = max(1, (1 << 18) // len(starts))  # items at a time, so that the table stays small
            for k in range(0, len(numbers), step):
                apart = _BITS16[own[:, None, :] ^ prints[None, k : k + step, :]]
                close = (apart <= radius // BLOCKS).any(2)
                w_at, n_at = np.nonzero(close)
                far = apart[w_at, n_at].sum(1, dtype=np.int64)
                for w, q, d in sorted(zip(w_at[far <= radius], n_at[far <= radius] + k, far[far <= radius]), key=lambda x: (x[2], x[0])):
                    number = numbers[q]
                    if number in best and best[number][0] == 1.0:
                        continue
                    s = int(starts[w])
                    found = _similarity(h[s : s + span], items.shingles[number], items)
                    if found >= threshold and (number not in best or (-found, s) < (-best[number][0], best[number][2])):
                        best[number] = (found, int(d), s, span)
    return best


def _find(column: pa.Array, groups: list[Items], radius: int, threshold: float):
    """(row, item id, similarity, distance, first word, words) of a column of normalised words."""
    for lo, hi, buf, offsets in string_batches(column):
        words, first, _, _ = word_hashes(buf, offsets)
        for items in groups:
            h, rows, _ = shingle_hashes(words, first, items.size)
            if not len(h):
                continue
            anchors = items.anchors(h)
            begins = np.searchsorted(rows, np.arange(hi - lo + 1))
            for row in np.unique(rows[anchors]):
                own = anchors[(anchors >= begins[row]) & (anchors < begins[row + 1])] - begins[row]
                for number, (s, d, start, span) in matches(h[begins[row] : begins[row + 1]], own, items, radius, threshold).items():
                    yield lo + int(row), items.ids[number], s, d, start, span + items.size - 1


def _benchmark_blocks(benchmark: DataFrame, limit: int):
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words_of(text_of()).alias("words")).filter("words <> ''").distinct()
    blocks = pieces(total_bytes(benchmark), limit)
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))
    for i in range(blocks):
        rows = (items.filter(block == i) if blocks > 1 else items).orderBy("item_id", "words").collect()  # one bounded block
        yield build([(r["item_id"], r["words"]) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """doc_id, item_id, similarity, distance, start_word, n_words: best window per document and item.

    Null and empty texts and items match nothing. A text shorter than an item is one window. Rows
    that repeat a doc_id give one row per item; matches of rows without doc_id carry a null. Of
    equally similar windows the first counts. An item_id with several texts matches by any of them.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text_of()).alias("words"))
    found = None
    for groups in _benchmark_blocks(benchmark, limit):
        def run(batches, groups=groups):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[row], *rest) for row, *rest in _find(batch.column("words"), groups, radius, threshold)]
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA)

        part = given.mapInArrow(run, "doc_id long, item_id long, similarity double, distance int, start_word int, n_words int")
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("similarity", "distance", "start_word", "n_words"), F.struct("similarity", -F.col("start_word"), -F.col("distance")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("distance", pa.int32()), ("start_word", pa.int32()), ("n_words", pa.int32())])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; nothing is shuffled."""
    out = docs.withColumn("__words", words_of(text_of()))
    for groups in _benchmark_blocks(benchmark, limit):
        def run(batches, groups=groups):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in _find(batch.column("__words"), groups, radius, threshold):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out.drop("__words")
