"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees.

A BK-tree keys the children of a node by their integer Hamming distance to it. A search that stands
at distance d of a node follows only the edges d - radius to d + radius.

One tree over all fingerprints cannot be held or sent anywhere, and every fingerprint meeting every
shard of it is quadratic. So the trees are sharded by blocks of bits: two fingerprints within the
radius agree in all but ``radius`` of the blocks, so that each choice of the other blocks' values is
a shard, and a fingerprint is a member and a query of the shards of its own values. A shard of more
than ``SHARD`` members is dealt into several trees, and each of these goes to all queries of the
shard, tree by tree. Every tree is bounded, and no link is lost at any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .components import components
from .runs import joined_runs, text_bytes, word_lists

BITS = 64
RADIUS = 4
RUN = 4  # words of a shingle
SEED = 42
SHARD = 8192  # members of one tree
MEAN_SHARD = 256  # members of a shard on average, by which the number of blocks is chosen
BUFFER = 1 << 16  # rows whose trees are built together
FRONTIER = 1 << 18  # (query, node) pairs that a search holds at a time


# --- fingerprints -----------------------------------------------------------------------------
def fingerprint(data: bytes, run: int = RUN, seed: int = SEED) -> int:
    """64 bits of one text: each is 1 if set in over half of the hashes of the text's word runs.

    A-Z count as lower case, words lie between ASCII white space, repeated runs count again. Fewer
    than ``run`` words are one run of all of them; no words give 0.
    """
    counts, total, words = np.zeros(BITS, np.int64), 0, []
    for words in word_lists(data.lower(), run - 1):
        if len(words) >= run:
            total += _add(counts, [xxhash.xxh64_intdigest(x, seed) for x in joined_runs(words, run)])
    if not total and words:
        total = _add(counts, [xxhash.xxh64_intdigest(b" ".join(words), seed)])
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _add(counts: np.ndarray, hashes: list[int]) -> int:
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 14):
        counts += np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(raw)


def fingerprints(docs: DataFrame, run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; null text counts as empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, run, seed) for x in text_bytes(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(task, "doc_id long, fp long")


# --- trees ------------------------------------------------------------------------------------
class Forest:
    """BK-trees of many shards, built together level by level.

    ``unit`` names the tree of each row; ``grows`` marks the rows that are members of it.
    """

    def __init__(self, fp: np.ndarray, unit: np.ndarray, grows: np.ndarray):
        self.fp = fp
        members = np.flatnonzero(grows)
        self.root = np.full(int(unit.max()) + 1 if len(unit) else 0, -1)
        self.root[unit[members][::-1]] = members[::-1]  # the first member of each unit
        rest = members[self.root[unit[members]] != members]
        at = self.root[unit[rest]]
        keys, nodes = [], []
        while len(rest):
            key = at * (BITS + 1) + np.bitwise_count(fp[rest] ^ fp[at]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            keys.append(key[first])
            nodes.append(rest[first])
            at = rest[first][np.cumsum(first) - 1][~first]
            rest = rest[~first]
        key, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(key)
        self.edges, self.children = key[order], node[order]

    def search(self, queries: np.ndarray, unit: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) within the radius, a query itself left out."""
        start = self.root[unit]
        stack = [(queries[start >= 0], start[start >= 0])]
        while stack:
            q, n = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[FRONTIER:], n[FRONTIER:]), (q[:FRONTIER], n[:FRONTIER])]
                continue
            d = np.bitwise_count(self.fp[q] ^ self.fp[n]).astype(np.int64)
            near = (d <= radius) & (q != n)
            if near.any():
                yield q[near], n[near]
            key = n * (BITS + 1)
            lo = np.searchsorted(self.edges, key + np.maximum(d - radius, 0), "left")
            count = np.searchsorted(self.edges, key + np.minimum(d + radius, BITS), "right") - lo
            if count.any():
                ahead = np.cumsum(count)
                step = np.arange(ahead[-1]) - np.repeat(ahead - count, count)
                stack.append((np.repeat(q, count), self.children[np.repeat(lo, count) + step]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: each class is named by its smallest row."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]


def _unit_links(fp: np.ndarray, unit: np.ndarray, side: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by unit: (member, representative) of each class within a unit, as fingerprints."""
    forest = Forest(fp, unit, side == 0)
    queries = np.flatnonzero(own | (side == 1))
    label = np.arange(len(fp))
    for q, n in forest.search(queries, unit[queries], radius):
        label = unite(label, q, n)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


# --- links ------------------------------------------------------------------------------------
def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks for which a shard holds ``MEAN_SHARD`` of n spread-out fingerprints at most."""
    k = radius + 1
    while k < BITS // 4 and n / 2 ** ((k - radius) * (BITS // k)) > MEAN_SHARD:
        k += 1
    return k


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bits of each choice of ``blocks - radius`` blocks, as signed 64-bit numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard: int = SHARD) -> DataFrame:
    """(u, v): links that join all distinct fingerprints ``fp`` within the radius, directly or by others.

    Within a tree and its queries only the classes are written, so a dense group of m fingerprints
    gives at most m links per shard and not its pairs.
    """
    blocks = blocks or blocks_for(fps.count(), radius)
    keys = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(blocks, radius))]
    member = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    large = member.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard).withColumn("parts", F.ceil(F.col("n") / shard).cast("int"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = member.join(large.select("t", "key", "parts"), ["t", "key"], "left").select("fp", "t", "key", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("p"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = met.select("fp", "t", "key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).cast("int").alias("side"))
    unit = ["t", "key", "i", "j"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = [*unit, "side", "fp"]

        def found(rows: np.ndarray) -> pa.RecordBatch:
            fresh = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            number = np.concatenate([[0], np.cumsum(fresh)])
            u, v = _unit_links(rows[:, 5].copy().view(np.uint64), number, rows[:, 4], rows[:, 2] == rows[:, 3], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([np.asarray(batch[c]).astype(np.int64) for c in names], axis=1))
            if sum(map(len, held)) < BUFFER:
                continue
            rows = np.concatenate(held)
            last = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on in the next batch
            held = [rows[whole:]]
            if whole:
                yield found(rows[:whole])
        if held and sum(map(len, held)):
            yield found(np.concatenate(held))

    return units.repartition(*unit).sortWithinPartitions(*unit, "side", "fp").mapInArrow(task, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, run: int = RUN, seed: int = SEED, blocks: int | None = None, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id (smallest doc_id that links reach).

    Null and empty texts have fingerprint 0, which links like any other. Rows without doc_id link too,
    but do not name a component; a component of such rows alone has a null name. Repeated rows come
    back each. Other columns are not read. No documents: no rows.
    """
    each = cut(fingerprints(docs, run, seed))
    known = cut(each.groupBy("fp").agg(F.min("doc_id").alias("lead")))
    roots = components(links(known.select("fp"), radius, blocks, shard))
    classed = known.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classed.groupBy("root").agg(F.min("lead").alias("component_id"))
    return each.join(classed.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
