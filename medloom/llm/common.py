"""Shared pieces of the corpus operators: word rules, table cuts and vectorised word hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.session import cut_lineage

SHINGLE = 5  # words
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the write's shuffle files go at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Lower-case words joined by one space; anything but letters, marks and digits separates."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def total_bytes(df: DataFrame, name: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(name)).cast("long")).alias("n")).first()["n"] or 0


def pieces(total: int, each: int) -> int:
    """Number of pieces of about ``each`` units: grows with the data, at least one."""
    return max(1, math.ceil(total / each))


# --- word hashing over Arrow string buffers ---------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_PAD = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_batches(column: pa.Array, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``limit`` bytes, ``rows`` at most: first row, end row, bytes, offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1), lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _hash_segment(buf: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf.astype(np.uint64) * up[: len(buf)], out=sums[1:])
    return mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * np.uint64(_ODD))


def word_hashes(buf: np.ndarray, offsets: np.ndarray, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all space-separated words, first word of each row, and the words' byte spans."""
    inside = buf != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = inside[starts]
    before = starts[starts > 0] - 1
    last[before] = inside[before]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, at = np.empty(len(b), np.uint64), 0
    while at < len(b):  # whole words, about ``segment`` bytes at a time
        to = max(at + 1, int(np.searchsorted(e, b[at] + segment, "right")))
        out[at:to] = _hash_segment(buf[b[at] : e[to - 1]], b[at:to] - b[at], e[at:to] - b[at])
        at = to
    return out, np.searchsorted(b, offsets), b, e


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words per row, each one's row, and its first word.

    A row with fewer words has one shingle of all of them; a row without words has none.
    """
    counts = np.diff(first)
    m = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    rows = np.repeat(np.arange(len(counts)), m)
    starts = first[:-1][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    short = counts[rows] < size if (counts < size).any() else None
    acc = np.zeros(len(rows), np.uint64)
    for j in range(size):
        w = padded[starts + j]
        if short is not None:
            w = np.where(short & (j >= counts[rows]), _PAD, w)
        acc = acc * np.uint64(_ODD) + w
    return mix(acc), rows, starts
