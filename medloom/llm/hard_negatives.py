"""Hard-negative mining with rotated one-bit codes.

Vectors are whole numbers floor(scale * x). Each is turned by a fixed random rotation and kept as the
signs of its coordinates, together with its alignment, the inner product with the unit vector of the
signs, and the length of the rest. A query is cut into bit planes, so popcounts of code and plane give
its inner product with the code. What code and planes leave out is bounded by Cauchy-Schwarz: every
score lies in a computed interval, with certainty. Rows whose interval cannot matter are left out; the
others are scored in whole numbers.

Rows and queries are dealt into cells of bounded size, every block of queries with every block of
rows. A task holds one block of rows and streams the queries past it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pieces

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
SHARE = (80, 100)  # a negative scores at least this part of the positive: share[0] / share[1]
BLOCK_BYTES = 64 << 20  # vectors of a block of rows as doubles
QUERIES = 1 << 17  # queries of a block
TILE = 1 << 21  # (query, row) pairs judged at once
PLANES = 4
TURNS = 3
SEED = 13
_SLACK = 1e-9  # rounding of the interval's own arithmetic, as a part of the lengths' product
_MOST = 2**63 - 1


# --- codes ------------------------------------------------------------------------------------
def whole(vectors: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these numbers exactly."""
    return np.floor(scale * vectors.astype(np.float64))


def rotate(v: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows turned by ``TURNS`` rounds of random signs and a Hadamard transform, padded to a power of two."""
    n = 1 << max(0, v.shape[1] - 1).bit_length()
    out = np.zeros((len(v), n))
    out[:, : v.shape[1]] = v
    rng = np.random.default_rng(seed)
    for _ in range(TURNS):
        out *= rng.integers(0, 2, n) * 2.0 - 1.0
        step = 1
        while step < n:
            pair = out.reshape(len(v), -1, 2, step)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(v), n)
            step *= 2
        out /= math.sqrt(n)
    return out


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (rows, n) to 64-bit words (rows, ceil(n / 64))."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view("<u8")


class Codes:
    """Sign codes of whole vectors with alignment and length of the rest."""

    def __init__(self, v: np.ndarray, seed: int = SEED):
        turned = rotate(v, seed)
        self.bits = turned.shape[1]
        self.words = pack(turned >= 0)
        self.align = np.abs(turned).sum(1) / math.sqrt(self.bits)
        square = (v * v).sum(1)
        self.length = np.sqrt(square)
        # a rest is never taken too short: the squares' own rounding is added
        self.rest = np.sqrt(np.maximum(square - self.align**2, 0) + square * 1e-12)

    def stored(self) -> list[pa.Array]:
        raw = np.ascontiguousarray(self.words).view(np.uint8).reshape(len(self.words), -1)
        return [pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(self.align), pa.array(self.rest), pa.array(self.length)]

    @classmethod
    def read(cls, columns: list, width: int) -> Codes:
        out = cls.__new__(cls)
        code, out.align, out.rest, out.length = columns[0], *(np.asarray(c, np.float64) for c in columns[1:])
        out.words = np.frombuffer(b"".join(code), "<u8").reshape(len(code), -1)
        out.bits = 1 << max(0, width - 1).bit_length()
        return out


def intervals(q: np.ndarray, codes: Codes, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): bounds of the inner products of all rows of ``q`` with all coded vectors."""
    turned = rotate(q, seed)
    n = turned.shape[1]
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / (2**PLANES - 1), 1e-300)
    level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
    error = np.linalg.norm(turned - (low[:, None] + step[:, None] * level), axis=1)
    length = np.linalg.norm(q, axis=1)
    ones = np.bitwise_count(codes.words).sum(1, dtype=np.int64)
    hits = np.zeros((len(q), len(ones)), np.int32)
    for p in range(PLANES):
        plane = pack((level >> p) & 1 == 1)
        for w in range(plane.shape[1]):
            hits += np.bitwise_count(plane[:, w, None] & codes.words[None, :, w]).astype(np.int32) << p
    # inner product of the levelled query with the unit vector of the signs
    flat = low[:, None] * (2 * ones - n)[None, :] + step[:, None] * (2 * hits - level.sum(1)[:, None])
    flat /= math.sqrt(n)
    across = np.sqrt(np.maximum(length[:, None] ** 2 - np.maximum(np.abs(flat) - error[:, None], 0) ** 2, 0))
    width = error[:, None] * codes.align[None, :] + across * codes.rest[None, :] + _SLACK * length[:, None] * codes.length[None, :] + _SLACK
    middle = flat * codes.align[None, :]
    return middle - width, middle + width


def scores(q: np.ndarray, v: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whole inner products of the pairs (q[at[0]], v[at[1]]); beyond a long's range, its end."""
    top = (np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0)) * max(1, q.shape[1])
    if top >= 2.0**53:  # beyond what doubles add exactly
        exact = [sum(int(a) * int(b) for a, b in zip(q[i], v[j])) for i, j in zip(*at)]
        return np.array([max(-_MOST - 1, min(_MOST, x)) for x in exact], np.int64)
    if 8 * len(at[0]) >= len(q) * len(v):
        return (q @ v.T)[at].astype(np.int64)
    out = np.empty(len(at[0]), np.int64)
    for a in range(0, len(out), 1 << 16):
        i, j = at[0][a : a + (1 << 16)], at[1][a : a + (1 << 16)]
        out[a : a + len(i)] = np.einsum("ij,ij->i", q[i], v[j])
    return out


def index(vectors: DataFrame, scale: float = SCALE, relabel: tuple[int, int, int] | None = None, seed: int = SEED) -> DataFrame:
    """(uid, vec_id, label, vec, code, align, rest, length): the code table of the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component take no part. ``relabel``
    (d, s, m): where vec_id is divisible by d, the label becomes (label + s) % m first.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.col("label").cast("long")
    if relabel:
        d, s, m = relabel
        label = F.when(F.col("vec_id") % d == 0, (label + s) % m).otherwise(label)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    width = rows.agg(F.max(F.size("vec")).alias("d")).first()["d"] or 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = whole(_padded(batch["vec"], width), scale)
            flat = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * width, v.ravel())
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["vec_id"], batch["label"], flat, *Codes(v, seed).stored()],
                                             ["uid", "vec_id", "label", "vec", "code", "align", "rest", "length"])

    return cut(rows.mapInArrow(task, "uid long, vec_id long, label long, vec array<double>, code binary, align double, rest double, length double"))


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles; shorter lists end in zeros."""
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


# --- cells ------------------------------------------------------------------------------------
class Block:
    """Rows of a cell as arrays."""

    def __init__(self, batch: pa.Table, width: int):
        self.uid, self.ids, self.label = (np.asarray(batch[c]).astype(np.int64) for c in ("uid", "vec_id", "label"))
        vec = batch["vec"].combine_chunks()
        self.v = _padded(vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec, width)
        self.codes = Codes.read([batch["code"].to_pylist(), batch["align"], batch["rest"], batch["length"]], width)


def top(query: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first ``k`` pairs by falling score, then id, then row."""
    order = np.lexsort((uid, ids, ~score, query))  # ~ turns the order of longs without overflow
    sorted_query = query[order]
    first = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - first < k]


def _floor_of(rows: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, -inf if there are fewer."""
    return np.partition(rows, rows.shape[1] - k, axis=1)[:, rows.shape[1] - k] if rows.shape[1] >= k else np.full(len(rows), -np.inf)


def _bounds(q: Block, rows: Block, at: slice) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the scores, which end where a long's range ends."""
    return tuple(np.clip(x, -(2.0**63), 2.0**63) for x in intervals(q.v[at], rows.codes))


def positives_in(q: Block, rows: Block, at: slice, k: int) -> pa.Table:
    """First ``k`` other rows of the same label for the queries ``at``, among ``rows``."""
    low, high = _bounds(q, rows, at)
    open_ = (q.label[at, None] == rows.label[None, :]) & (q.uid[at, None] != rows.uid[None, :])
    sure = _floor_of(np.where(open_, low, -np.inf), k)
    i, j = np.nonzero(open_ & (high >= sure[:, None]))
    s = scores(q.v[at], rows.v, (i, j))
    best = top(i, s, rows.ids[j], rows.uid[j], k)
    i, j, s = i[best], j[best], s[best]
    return pa.table({"uid": q.uid[at][i], "anchor_id": q.ids[at][i], "vec_id": rows.ids[j], "other": rows.uid[j], "score": s})


def negatives_in(q: Block, goals: np.ndarray, known: np.ndarray, rows: Block, at: slice, k: int, share: tuple[int, int]) -> pa.Table:
    """For each query and each of its positives' scores, the first ``k`` rows of another label within the share.

    ``goals``: (queries, positives) scores, given where ``known``.
    """
    own, known = goals[at], known[at]
    low, high = _bounds(q, rows, at)
    open_ = q.label[at, None] != rows.label[None, :]
    most = own.astype(np.float64)
    least = most * (share[0] / share[1])
    slack = 1 + np.abs(most) * 1e-12 + np.abs(least) * 1e-12
    # per goal: intervals wholly inside its range already hold the first k at these places
    need = np.full(own.shape, np.inf)
    for p in np.flatnonzero(known.any(0)):
        inside = open_ & (low >= (least + slack)[:, p, None]) & (high <= (most - slack)[:, p, None])
        first = _floor_of(np.where(inside, low, -np.inf), k)
        need[:, p] = np.where(known[:, p], np.maximum((least - slack)[:, p], first), np.inf)
    ceiling = np.where(known, most + slack, -np.inf).max(1)
    i, j = np.nonzero(open_ & (high >= need.min(1)[:, None]) & (low <= ceiling[:, None]))
    s = scores(q.v[at], rows.v, (i, j))
    room = _MOST // (2 * max(map(abs, share)))
    large = max(np.abs(most).max(initial=0), np.abs(s.astype(np.float64)).max(initial=0)) > room
    wide = s.astype(object) if large else s  # products beyond a long are taken in whole numbers without bounds
    out = []
    for p in range(own.shape[1]):
        goal = own[i, p].astype(wide.dtype)
        fits = np.flatnonzero(known[i, p] & (share[0] * goal <= share[1] * wide).astype(bool) & (wide <= goal).astype(bool))
        best = fits[top(i[fits], s[fits], rows.ids[j[fits]], rows.uid[j[fits]], k)]
        out.append(pa.table({"uid": q.uid[at][i[best]], "place": np.full(len(best), p, np.int64), "vec_id": rows.ids[j[best]], "other": rows.uid[j[best]], "score": s[best]}))
    return pa.concat_tables(out)


def _over_cells(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, width: int, judge: Callable, schema: str) -> DataFrame:
    """``judge(query block, row block, extra columns, slice)`` for every block of queries and every block of rows."""
    sc = rows.sparkSession.sparkContext
    r = max(pieces(n_rows * width * 8, BLOCK_BYTES), min(2 * sc.defaultParallelism, pieces(n_rows, 512)))
    a = pieces(n_queries, QUERIES)
    deal = lambda n, salt: F.pmod(F.xxhash64(F.col("uid"), F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("goals", F.lit(None).cast("array<long>")).withColumn("kind", F.lit(0)).withColumn("r", deal(r, 1)).withColumn("a", every(a))
    right = queries.withColumn("kind", F.lit(1)).withColumn("a", deal(a, 2)).withColumn("r", every(r))
    cells = left.unionByName(right).withColumn("cell", F.col("r") * a + F.col("a")).drop("r", "a")
    names = cells.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            number, kind = (np.asarray(batch[c]) for c in ("cell", "kind"))
            edges = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if number[lo] != cell:
                    cell, held, block = number[lo], [], None
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if held:
                    block, held = Block(pa.concat_tables(held), width), []
                if block is None:
                    continue
                q = Block(part, width)
                size = max(1, TILE // len(block.uid))
                for at in range(0, hi - lo, size):
                    yield from judge(q, part["goals"].to_pylist(), block, slice(at, at + size)).to_batches()

    dealt = cells.repartitionById(r * a, F.col("cell").cast("int")) if r * a > 1 else cells.repartition(1)
    return dealt.sortWithinPartitions("cell", "kind").select(*names).mapInArrow(task, schema)


def _first(found: DataFrame, key: list[str], k: int, name: str) -> DataFrame:
    order: list[Column] = [F.col("score").desc(), F.col("vec_id"), F.col("other")]
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, relabel: tuple[int, int, int] | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   share: tuple[int, int] = SHARE, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are its first
    ``positives`` other rows of the same label, by falling score, then vec_id; for each, the first
    ``negatives`` rows of other labels are returned whose score lies between share[0] / share[1] of the
    positive's score and that score. Rows are told apart as rows: a repeated row is another row, and a
    repeated anchor is mined twice. Shorter vectors count as ended by zeros; scores beyond the range of
    a long are its ends. ``index`` says which rows take part. Extra columns are not read. No anchors,
    no positives or no negatives: no rows.
    """
    rows = index(vectors, scale, relabel, seed)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("vec")).alias("d")).first()
    n, n_queries, width = size["n"], size["q"], size["d"] or 1
    anchors = rows.filter(F.col("vec_id") % every == 0)
    plain = anchors.withColumn("goals", F.lit(None).cast("array<long>"))
    near = _over_cells(rows, plain, n, n_queries, width, lambda q, _, b, at: positives_in(q, b, at, positives), "uid long, anchor_id long, vec_id long, other long, score long")
    chosen = cut(_first(near, ["uid"], positives, "place").withColumn("place", F.col("place") - 1))
    goals = chosen.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("goals"))  # at most ``positives`` each

    def judge(q: Block, given: list, block: Block, at: slice) -> pa.Table:
        table = np.zeros((len(given), positives), np.int64)
        for i, g in enumerate(given):
            table[i, : len(g)] = g
        known = np.arange(positives)[None, :] < np.array([len(g) for g in given])[:, None]
        return negatives_in(q, table, known, block, at, negatives, share)

    far = _over_cells(rows, anchors.join(goals, "uid"), n, n_queries, width, judge, "uid long, place long, vec_id long, other long, score long")
    ranked = _first(far, ["uid", "place"], negatives, "rank").select("uid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select("uid", F.col("place").cast("long").alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["uid", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
