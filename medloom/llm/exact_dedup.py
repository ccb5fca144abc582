"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text is cut into chunks of bytes. A chunk hash is a polynomial of its bytes modulo two primes;
the hash of a whole text is the sum of its chunk hashes, each shifted by the number of bytes that
follow it. The sum is associative, so the chunks of one huge document are hashed by many tasks.
Texts with equal fingerprints and lengths are then compared byte by byte, chunk against the same
chunk of one chosen member; those that differ choose a member among themselves, until all settled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

CHUNK = 1 << 20  # bytes hashed by one task at a time
COMPARE = 1 << 16  # bytes compared at a time
PRIMES = ((2_147_483_647, 131_071_393), (2_147_483_629, 524_287_819))  # (modulus, base)
_PANEL = 4096


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base % modulus
    return out[::-1].copy()  # the first byte has the highest power


def polynomial(data: np.ndarray, offsets: np.ndarray, modulus: int, base: int, table: np.ndarray) -> np.ndarray:
    """Hash of each row's bytes. Panels of 4,096 bytes are summed, then folded: no overflow."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint64)
    step = pow(base, _PANEL, modulus)
    for row in np.flatnonzero(lengths):
        part = data[offsets[row] : offsets[row + 1]].astype(np.uint64) + np.uint64(1)
        head = len(part) % _PANEL
        value = int(part[:head] @ table[_PANEL - head :]) % modulus if head else 0
        if len(part) > head:
            for panel in part[head:].reshape(-1, _PANEL) @ table:
                value = (value * step + int(panel)) % modulus
        out[row] = value
    return out


def _fingerprint_batches(primes: tuple[tuple[int, int], ...]):
    def run(batches):
        tables = [_powers(base, modulus, _PANEL) for modulus, base in primes]
        for batch in batches:
            column = batch.column("piece").cast(pa.large_binary())
            n = len(column)
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
            raw = column.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            after = batch.column("after").to_pylist()
            parts = []
            for (modulus, base), table in zip(primes, tables):
                h = polynomial(data, offsets, modulus, base, table)
                parts.append(pa.array([int(x) * pow(base, a, modulus) % modulus if a else int(x) for x, a in zip(h, after)], pa.int64()))
            keep = [batch.column(c) for c in ("doc_id", "text_sha256", "n_bytes", "chunk")]
            yield pa.RecordBatch.from_arrays(keep + parts, names=["doc_id", "text_sha256", "n_bytes", "chunk", "h0", "h1"])

    return run


def _chunks(size: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / size) - 1, F.lit(0)).cast("int"))


def _base(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("bytes"),
    )


def fingerprints(docs: DataFrame, chunk: int = CHUNK, primes=PRIMES) -> DataFrame:
    """One row per input row and text: doc_id, text_sha256, n_bytes, h0, h1, n (equal rows)."""
    base = _base(docs)
    short = base.filter(F.col("n_bytes") <= chunk).select("doc_id", "text_sha256", "n_bytes", F.lit(0).alias("chunk"), F.col("bytes").alias("piece"), F.lit(0).cast("long").alias("after"))
    # chunks of long documents are dealt out, so one document's chunks run side by side
    long = base.filter(F.col("n_bytes") > chunk).withColumn("chunk", F.explode(_chunks(chunk)))
    long = long.select(
        "doc_id", "text_sha256", "n_bytes", "chunk",
        F.substring(F.col("bytes"), F.col("chunk") * chunk + 1, F.lit(chunk)).alias("piece"),
        F.greatest(F.col("n_bytes") - (F.col("chunk").cast("long") + 1) * chunk, F.lit(0)).cast("long").alias("after"),
    ).repartition("doc_id", "chunk")
    schema = "doc_id long, text_sha256 string, n_bytes long, chunk int, h0 long, h1 long"
    hashed = reduce(DataFrame.unionByName, [part.mapInArrow(_fingerprint_batches(primes), schema) for part in (short, long)])
    # repeated rows give each chunk several times over: divide them out by counting the first chunk
    per_chunk = hashed.groupBy("doc_id", "text_sha256", "n_bytes", "chunk", "h0", "h1").agg(F.count(F.lit(1)).alias("n"))
    return per_chunk.groupBy("doc_id", "text_sha256", "n_bytes").agg(
        (F.sum("h0") % primes[0][0]).alias("h0"), (F.sum("h1") % primes[1][0]).alias("h1"), F.min("n").alias("n"))


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK, compare: int = COMPARE, primes=PRIMES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document.

    Null text counts as empty, empty texts are equal. Of equal texts the largest doc_id stays (a
    null doc_id only if there is no other). Rows equal in doc_id and text come back as one row and
    count as many in group_size. One doc_id with two texts gives two rows. No rows: no rows.
    """
    prints = cut(fingerprints(docs, chunk, primes))
    key = ["n_bytes", "h0", "h1", "turn"]
    todo = prints.withColumn("turn", F.lit(0))
    settled = []
    turn = 0
    while True:
        heads = todo.groupBy(*key).agg(F.max(F.struct("doc_id", "text_sha256")).alias("head"), F.count(F.lit(1)).alias("members"))
        grouped = todo.join(heads, key)
        alone = grouped.filter("members = 1").withColumn("same", F.lit(True))
        several = grouped.filter("members > 1")
        texts = _base(docs).dropDuplicates(["doc_id", "text_sha256"]) if turn else _base(docs)
        texts = texts.select(F.col("doc_id").alias("t_id"), F.col("text_sha256").alias("t_sha"), "bytes")
        joined = several.join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_sha256") == F.col("t_sha")))
        parts = joined.select(
            "doc_id", "text_sha256", *key, "head", F.explode(_chunks(compare)).alias("part"), "bytes",
        ).withColumn("bytes", F.substring(F.col("bytes"), F.col("part") * compare + 1, F.lit(compare)))
        own = (F.col("doc_id").eqNullSafe(F.col("head.doc_id"))) & (F.col("text_sha256") == F.col("head.text_sha256"))
        lead = parts.filter(own).dropDuplicates([*key, "part"]).select(*key, "part", F.col("bytes").alias("lead"))
        checked = parts.join(lead, [*key, "part"]).groupBy("doc_id", "text_sha256", *key).agg(F.bool_and(F.col("bytes") == F.col("lead")).alias("same"))
        compared = several.alias("s").join(
            checked.alias("c"),
            F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.text_sha256") == F.col("c.text_sha256")),
        ).select("s.*", "c.same")
        done = cut(alone.unionByName(compared).drop("members"))
        settled.append(done.filter("same").withColumn("group", F.col("head")))
        rest = done.filter(~F.col("same")).drop("same", "head")
        if rest.isEmpty():
            break
        turn += 1  # only when different texts share a fingerprint
        todo = rest.withColumn("turn", F.lit(turn))
    rows = reduce(DataFrame.unionByName, settled)
    sizes = rows.groupBy(*key, "group").agg(F.sum("n").alias("group_size"))
    return rows.join(sizes, [*key, "group"]).select(
        "doc_id", F.col("group.doc_id").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("group.doc_id")).alias("kept"), "text_sha256")
