"""Packed token ids for training: best-fit-decreasing rows of one context length.

Texts are tokenised in Arrow batches and end with an end-of-text id. A document longer than the
context is split into whole contexts and a rest. Pieces are dealt by a hash into shards of bounded
size; each shard is packed longest piece first, each into the row with the least room that still
takes it, found in a segment tree over room sizes. A row of the result is one row of the matrix,
with cumulative segment lengths and position ids that start again at each segment.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, text_of, total_bytes

CONTEXT = 2048
SHARD_BYTES = 8 << 20  # of text packed by one task
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pre-tokenisation rule that belongs to the vocabulary, in possessive form
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END = 50_256  # free in the vocabulary: closes every document


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _piece_batches(path: str, context: int, end: int, shards: int, dtype: str):
    def run(batches):
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            out: dict[str, list] = {"row": [], "piece": [], "tokens": [], "ids": [], "shard": []}
            for row in range(batch.num_rows):
                tokens = encode(texts[row].as_py())
                tokens.append(end)
                flat = np.array(tokens, dtype)
                # a shard depends on id and piece only, so the same rows land in the same shards
                name = ids[row].as_py()
                seed = np.uint64((0 if name is None else name) & (2**64 - 1))
                for piece, at in enumerate(range(0, len(flat), context)):
                    part = flat[at : at + context]
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["tokens"].append(len(part))
                    out["ids"].append(part.tobytes())
                    out["shard"].append(int(mix(np.array([seed * np.uint64(31) + np.uint64(piece)], np.uint64))[0] % np.uint64(shards)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(out["row"], pa.int32())), pa.array(out["piece"], pa.int32()), pa.array(out["tokens"], pa.int32()), pa.array(out["ids"], pa.binary()), pa.array(out["shard"], pa.int32())],
                names=["doc_id", "piece", "tokens", "ids", "shard"])

    return run


class RoomTree:
    """Rows by the room they have left: the leaves are room sizes, inner nodes count rows below."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the smallest room of at least ``need``."""
        count = self.count
        node = need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # climb until a right neighbour has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of item numbers; ``lengths`` must fall. Items as long as a row need no search."""
    tree = RoomTree(capacity)
    rows: list[list[int]] = []
    for item, length in enumerate(lengths.tolist()):
        found = tree.take(length) if length < capacity else None
        if found is None:
            rows.append([item])
            left, row = capacity - length, len(rows) - 1
        else:
            left, row = found[0] - length, found[1]
            rows[row].append(item)
        if left:
            tree.add(left, row)
    return rows


def _pack(context: int, pad: int, dtype: str):
    def run(key, table):
        table = table.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("tokens").to_numpy()
        rows = best_fit_decreasing(lengths, context)
        blob = [x.as_py() for x in table.column("ids")]
        items = np.concatenate([np.array(r, np.int64) for r in rows])
        per_row = np.array([len(r) for r in rows])
        ends = np.cumsum(per_row)
        ids, places, cumulative, filled = [], [], [], []
        ladder = np.arange(context, dtype="<u4" if context > 65536 else "<u2")
        for r in rows:
            data = b"".join(blob[i] for i in r)
            used = len(data) // np.dtype(dtype).itemsize
            filled.append(used)
            ids.append(data + np.full(context - used, pad, dtype).tobytes())
            places.append(b"".join([*(ladder[: lengths[i]].tobytes() for i in r), ladder[: context - used].tobytes()]))
            cumulative.append(np.concatenate([[0], np.cumsum(lengths[r])]).astype(np.int32))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        lists = lambda c: pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks().take(pa.array(items)))
        n = len(rows)
        return pa.table({
            "shard": pa.array([key[0].as_py()] * n, pa.int32()), "row": pa.array(np.arange(n, dtype=np.int32)),
            "input_ids": pa.array(ids, pa.binary()), "position_ids": pa.array(places, pa.binary()), "cu_seqlens": pa.array(cumulative, pa.list_(pa.int32())),
            "n_tokens": pa.array(filled, pa.int32()), "doc_ids": lists("doc_id"), "pieces": lists("piece"),
        })

    return run


def pack(docs: DataFrame, context: int = CONTEXT, vocabulary: str = VOCABULARY, end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows of the packed matrix: shard, row, input_ids, position_ids, cu_seqlens, n_tokens, doc_ids, pieces.

    ``input_ids`` holds ``context`` little-endian ids (two bytes each up to 65,536 ids, else four),
    filled up with the end id; ``position_ids`` as many positions that start again at each segment
    and in the filling; ``cu_seqlens`` the segment bounds, ending at ``n_tokens``; ``doc_ids`` and
    ``pieces`` say which part of which document each segment is. Null and empty texts are a segment
    of the end id alone. Repeated rows and rows without doc_id are packed like any other. No rows
    give no rows. Pieces of a document joined in order, without the last id, are its tokens.
    """
    dtype = "<u2" if end < 65536 else "<u4"
    shards = pieces(total_bytes(docs), shard_bytes)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cut_up = given.mapInArrow(_piece_batches(vocabulary, context, end, shards, dtype), "doc_id long, piece int, tokens int, ids binary, shard int")
    schema = "shard int, row int, input_ids binary, position_ids binary, cu_seqlens array<int>, n_tokens int, doc_ids array<long>, pieces array<int>"
    return cut_up.groupBy("shard").applyInArrow(_pack(context, end, dtype), schema)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet, one folder per shard: ids and positions as fixed-width bytes."""
    packed.write.mode("overwrite").partitionBy("shard").parquet(path)
