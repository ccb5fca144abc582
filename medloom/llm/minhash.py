"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

1. Texts are dealt into groups of bounded bytes by a hash of their id. A group sends each distinct
   shingle once, with its count of documents, to the task of the shingle's hash range and gets back
   the number of documents of the whole corpus. A shingle that is in every document costs one entry
   per group.
2. Each text is drawn by improved consistent weighted sampling from its shingles, weighted by count
   times inverse document frequency. Draws are banded; texts that agree in a band are candidates.
3. Candidates of a band bucket are compared with the bucket's hub (the member with most company over
   all its bands). A bucket whose members are not one class by then stays open: members of different
   classes meet in slots of growing width, at last all of them, so that no pair is left undecided.
   Narrow slots give rows of pairs, less those that an exact prefix filter over weighted shingles rules
   out. Wide slots are cut into blocks of bounded size, and each two blocks are compared in one task,
   which writes links only.
4. A link needs a weighted Jaccard similarity of at least the threshold, computed from whole texts.
   Classes are the connected components of the links.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, pieces, shingle_hashes, string_batches, text_of, total_bytes, word_hashes, words_of
from .components import components

THRESHOLD = 0.8
BANDS = 12
ROWS = 4  # a pair at 0.8 is missed in 1 of 550 cases, at 0.9 in 1 of 90,000
GROUP_BYTES = 8 << 20  # of text in one task's hands
HASH_BITS = 56
WIDTH, WIDEN = 4, 16  # members of a slot of an open bucket at first, and its growth a round
BLOCK, BLOCK_BYTES = 1024, 32 << 20  # members of a wide slot in one block, and bytes of their shingles
CODES = 255  # levels of inverse document frequency


# --- weights -----------------------------------------------------------------------------------


def idf_codes(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency in 255 steps: 255 for one document, falling with the logarithm.

    The weight is 1 + log(N / df) / log(N), between 1 and 2, so that copies of one text stay alike
    even where thousands of them make their own shingles frequent.
    """
    top = max(np.log(max(n_docs, 2)), 1e-9)
    return np.clip(np.rint(CODES * (1 - np.log(np.maximum(df, 1)) / top)), 0, CODES).astype(np.uint8)


def weight_of(codes: np.ndarray) -> np.ndarray:
    return (1 + codes.astype(np.float32) / CODES).astype(np.float32)


def _group_shingles(column, limit: int = 1 << 18):
    """Hashes (56 bits) and row of every shingle of a column, in slices of bounded bytes and 256 rows."""
    for lo, hi, buf, offsets in string_batches(column, limit, 1 << (64 - HASH_BITS)):
        words, first, _, _ = word_hashes(buf, offsets)
        h, rows, _ = shingle_hashes(words, first)
        yield lo, hi, h >> np.uint64(64 - HASH_BITS), rows


def _counted(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in that order with their counts; the row stands above the hash's 56 bits."""
    both = np.sort((rows.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
    at = np.flatnonzero(np.diff(both, prepend=~both[:1]))
    both, tf = both[at], np.diff(np.append(at, len(both)))
    return both & np.uint64((1 << HASH_BITS) - 1), (both >> np.uint64(HASH_BITS)).astype(np.int64), tf


def _pack(sorted_hashes: np.ndarray, base: int) -> bytes:
    """Ascending numbers as byte planes of their differences."""
    d = np.diff(sorted_hashes, prepend=np.uint64(base))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes, base: int) -> np.ndarray:
    width, n = data[0], (len(data) - 1) // data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    d = out.view(np.uint64).ravel().copy()
    d[0] += np.uint64(base)
    return np.cumsum(d)


def _send(bits: int):
    shift = np.uint64(HASH_BITS - bits)

    def run(key, table):
        parts = []
        for _, _, h, rows in _group_shingles(table.column("words")):
            parts.append(_counted(h, rows)[0])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        hashes, counts = np.unique(flat, return_counts=True)
        part, at = np.unique(hashes >> shift, return_index=True)
        ends = np.append(at[1:], len(hashes))[: len(at)]
        counts = counts.astype(np.uint32)
        return pa.table({
            "part": pa.array(part.astype(np.int64)), "g": pa.array([key[0].as_py()] * len(part), pa.int32()),
            "hashes": pa.array([_pack(hashes[i:j], int(p) << int(shift)) for p, i, j in zip(part, at, ends)], pa.binary()),
            "counts": pa.array([counts[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()),
        })

    return run


def _total(bits: int, n_docs: int):
    def run(key, table):
        low = key[0].as_py() << (HASH_BITS - bits)
        lists = [_unpack(x.as_py(), low) for x in table.column("hashes")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        sizes = np.array([len(x) for x in lists])
        _, back = np.unique(np.concatenate(lists), return_inverse=True)
        codes = idf_codes(np.bincount(back, weights=counts)[back], n_docs)
        ends = np.cumsum(sizes)
        return pa.table({
            "part": table.column("part"), "g": table.column("g"),
            "codes": pa.array([codes[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary()),
        })

    return run


def document_frequency(docs: DataFrame, groups: int, n_docs: int) -> DataFrame:
    """(g, part, codes): weights of each group's distinct shingles in order of their hashes."""
    bits = (groups - 1).bit_length()
    sent = docs.groupBy("g").applyInArrow(_send(bits), "part long, g int, hashes binary, counts binary")
    return sent.groupBy("part").applyInArrow(_total(bits, n_docs), "part long, g int, codes binary")


# --- sampling ----------------------------------------------------------------------------------

_TABLE_BITS = 16


@lru_cache(1)
def _draws() -> tuple[np.ndarray, ...]:
    """1 / r, beta, r and log c + r * beta - r: r and c gamma(2, 1), beta uniform. Fixed by the seed."""
    rng = np.random.Generator(np.random.PCG64(20_240_229))
    n = 1 << _TABLE_BITS
    r, beta, c = rng.gamma(2.0, 1.0, n), rng.random(n), rng.gamma(2.0, 1.0, n)
    return tuple(x.astype(np.float32) for x in (1 / r, beta, r, np.log(c) + r * beta - r))


def samples(h: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k consistent samples for each run of shingles that begins at ``starts``: runs x k numbers.

    With t = floor(log w / r + beta), the sample is the shingle of least log a = log c - r (t - beta + 1),
    together with its t. Of equal values the smallest hash counts, which comes first in its run.
    """
    out = np.empty((len(starts), k), np.uint64)
    inverse, beta, r, q = _draws()
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    spread = mix(h)
    low = (spread >> np.uint64(32)).astype(np.uint32)
    counts = np.diff(np.append(starts, len(h)))
    for j in range(k):
        at = ((low * seeds[j] + seeds[k + j]) >> np.uint32(32 - _TABLE_BITS)).astype(np.intp)
        t = np.floor(log_weight * inverse[at] + beta[at])
        log_a = q[at] - r[at] * t
        least = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == np.repeat(least, counts))
        chosen = hits[np.searchsorted(hits, starts)]
        out[:, j] = mix(spread[chosen] + t[chosen].astype(np.int64).view(np.uint64))
    return out


def _band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sample), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * np.uint64(31) + sample[:, r::rows][:, :bands] + np.uint64(1))
    return keys.view(np.int64)


def _sign(bands: int, rows: int):
    def run(key, docs, frequency):
        parts = frequency.sort_by("part").column("codes")
        codes = np.frombuffer(b"".join(x.as_py() for x in parts), np.uint8)
        slices = [(lo, hi, *_counted(h, rows_)) for lo, hi, h, rows_ in _group_shingles(docs.column("words"))]
        known = np.unique(np.concatenate([s[2] for s in slices])) if slices else np.zeros(0, np.uint64)
        bands_out, codes_out = [None] * docs.num_rows, [b""] * docs.num_rows
        for lo, hi, h, rows_, tf in slices:
            if not len(h):
                continue
            own = codes[np.searchsorted(known, h)]
            starts = np.flatnonzero(np.diff(rows_, prepend=-1))
            ends = np.append(starts[1:], len(h))
            log_weight = np.log(tf.astype(np.float32) * weight_of(own))
            keys = _band_keys(samples(h, log_weight, starts, bands * rows), bands, rows)
            for i, (s, e) in enumerate(zip(starts, ends)):
                codes_out[lo + rows_[s]] = own[s:e].tobytes()
                bands_out[lo + rows_[s]] = keys[i]
        return pa.table({
            "doc_id": docs.column("doc_id"), "same": docs.column("same"), "words": docs.column("words"),
            "codes": pa.array(codes_out, pa.binary()), "bands": pa.array(bands_out, pa.list_(pa.int64())),
        })

    return run


# --- links -------------------------------------------------------------------------------------


def _weighted_set(words: pa.Array, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([x[2] for x in _group_shingles(words)])
    h, _, tf = _counted(h, np.zeros(len(h), np.int64))
    return h, tf * weight_of(np.frombuffer(codes, np.uint8)).astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def _compare(batches):
    seen, lead = None, None
    for batch in batches:
        out = []
        sides = {c: batch.column(c).cast(pa.string()) for c in ("words", "hub_words")}
        for i, (hub, code, hub_code) in enumerate(zip(batch.column("hub"), batch.column("codes"), batch.column("hub_codes"))):
            if hub != seen:  # rows of one hub follow each other
                seen, lead = hub, _weighted_set(sides["hub_words"].slice(i, 1), hub_code.as_py())
            out.append(weighted_jaccard(_weighted_set(sides["words"].slice(i, 1), code.as_py()), lead))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hub"), pa.array(out, pa.float64())], names=["doc_id", "hub", "similarity"])


def _hub_pairs(buckets: DataFrame) -> DataFrame:
    """(band, key, doc_id, hub): each member of a bucket with company, beside the bucket's hub."""
    sizes = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = buckets.join(sizes, ["band", "key"])
    company = shared.groupBy("doc_id").agg(F.sum("n").alias("company"))
    ranked = shared.join(company, "doc_id")
    hubs = ranked.groupBy("band", "key").agg(F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("hub"))
    return cut(shared.join(hubs, ["band", "key"]).select("band", "key", "doc_id", "hub"))


def verified(pairs: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, hub, similarity) of the pairs at or above the threshold; ``pool`` has their texts."""
    lead = pool.select(F.col("doc_id").alias("hub"), F.col("words").alias("hub_words"), F.col("codes").alias("hub_codes"))
    lead = lead.join(pairs.select("hub").distinct(), "hub", "left_semi")
    both = pairs.join(pool, "doc_id").join(lead, "hub")
    return both.mapInArrow(_compare, "doc_id long, hub long, similarity double").filter(F.col("similarity") >= threshold)


MARKS = "doc_id long, total double, prefix array<int>, hashes binary, weights binary, size long"


def _marks(threshold: float):
    """Columns ``MARKS`` of texts: total weight, 32 bits of the shingles of the prefix, and the weighted shingles.

    Shingles stand rarest first. Two texts whose prefixes share none have all their common weight in
    one text's rest, which is less than ``threshold`` of its total: they cannot be a link.
    """
    def run(batches):
        for batch in batches:
            words, totals, prefixes, hashes, weights = batch.column("words").cast(pa.string()), [], [], [], []
            for i, code in enumerate(batch.column("codes")):
                h, w = _weighted_set(words.slice(i, 1), code.as_py())
                order = np.lexsort((h, -np.frombuffer(code.as_py(), np.uint8).astype(np.int16)))
                rest = w.sum() - np.cumsum(w[order])
                k = int(np.argmax(rest < (threshold - 1e-9) * w.sum())) + 1 if threshold > 1e-9 else len(h)
                totals.append(float(w.sum()))
                prefixes.append(np.unique(h[order[:k]].astype(np.uint32).view(np.int32)))
                hashes.append(h.tobytes())
                weights.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(totals, pa.float64()), pa.array(prefixes, pa.list_(pa.int32())),
                pa.array(hashes, pa.binary()), pa.array(weights, pa.binary()), pa.array([2 * len(x) for x in hashes], pa.int64()),
            ], names=["doc_id", "total", "prefix", "hashes", "weights", "size"])

    return run


def _open_buckets(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """(band, key, doc_id, root, main, n): buckets whose members links do not join into one class.

    ``main`` is the class with most members in the bucket, ``n`` the number of all members.
    """
    roots = components(links.select(F.col("doc_id").alias("u"), F.col("hub").alias("v")))
    placed = cut(buckets.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    counts = placed.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    parted = counts.groupBy("band", "key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    return cut(placed.join(parted.filter("parts > 1").drop("parts"), ["band", "key"]))


def _dealt(members: DataFrame, width: int) -> DataFrame:
    slots = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("n") / F.lit(width))), F.lit(0))).cast("long")
    return members.withColumn("slot", F.pmod(F.xxhash64("doc_id"), slots))


def _open_pairs(members: DataFrame, marks: DataFrame, width: int, threshold: float) -> DataFrame:
    """(doc_id, hub): pairs of an open bucket from different classes that can reach the threshold.

    A bucket is dealt into slots of about ``width`` members; up to ``width`` members it is one slot
    and gives all its pairs. Members of the main class never meet each other.
    """
    dealt = cut(_dealt(members, width).join(marks.select("doc_id", "total", "prefix"), "doc_id"))
    side = lambda t, x: t.select("band", "key", "slot", *(F.col(c).alias(c + x) for c in ("doc_id", "root", "total", "prefix")))
    both = side(dealt.filter("root <> main"), "_a").join(side(dealt, "_b"), ["band", "key", "slot"])
    near = F.least("total_a", "total_b") >= (threshold - 1e-9) * F.greatest("total_a", "total_b")
    kept = both.filter((F.col("root_a") != F.col("root_b")) & near & F.arrays_overlap("prefix_a", "prefix_b"))
    return kept.select(F.greatest("doc_id_a", "doc_id_b").alias("doc_id"), F.least("doc_id_a", "doc_id_b").alias("hub")).distinct()


def _cell_pairs(threshold: float):
    """Links between the two blocks of a cell, or within its only one, of members of different classes.

    Common weight is at most what either text has in shingles that another member holds too; pairs that
    pass this bound are summed over those shingles, and what reaches the threshold is compared in full.
    """
    least = threshold / (1 + threshold)  # of both totals, as common weight

    def run(key, table):
        doc, root, block = (table.column(c).to_numpy() for c in ("doc_id", "root", "block"))
        order = np.lexsort((doc, block))
        doc, root, block = doc[order], root[order], block[order]
        column = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(c).take(pa.array(order))]
        sets = list(zip(column("hashes", np.uint64), column("weights", np.float64)))
        n, sizes = len(sets), np.array([len(h) for h, _ in sets])
        weights = np.concatenate([w for _, w in sets])
        total = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
        known, local, held = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
        common = held[local] > 1
        local, weights, rows = local[common], weights[common], np.repeat(np.arange(n), sizes)[common]
        first = np.searchsorted(rows, np.arange(n + 1))
        most = np.bincount(rows, weights, n)
        line, found = np.zeros(len(known)), []
        split = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
        for a in range(split or n):
            rest = np.arange(split or a + 1, n)
            need = least * (total[a] + total[rest]) * (1 - 1e-9)
            rest = rest[(root[rest] != root[a]) & (np.minimum(most[a], most[rest]) >= need)]
            if not len(rest):
                continue
            line[local[first[a] : first[a + 1]]] = weights[first[a] : first[a + 1]]
            length = first[rest + 1] - first[rest]
            at = np.repeat(first[rest] - np.cumsum(length) + length, length) + np.arange(length.sum())
            shared = np.bincount(np.repeat(np.arange(len(rest)), length), np.minimum(line[local[at]], weights[at]), len(rest))
            line[local[first[a] : first[a + 1]]] = 0
            for b in rest[shared >= least * (total[a] + total[rest]) * (1 - 1e-9)]:
                found.append((max(doc[a], doc[b]), min(doc[a], doc[b]), weighted_jaccard(sets[a], sets[b])))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*found) if found else ([], [], []), (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "hub", "similarity"])

    return run


def _cell_links(members: DataFrame, marks: DataFrame, width: int, threshold: float) -> DataFrame:
    """(doc_id, hub, similarity): links between members of different classes in slots of about ``width``.

    A slot is cut into blocks by the number of its members and the bytes of their shingles; each two
    blocks, and each block with itself, are one cell.
    """
    slot = ["band", "key", "slot"]
    dealt = cut(_dealt(members, width).join(marks.select("doc_id", "size"), "doc_id"))
    sizes = dealt.groupBy(*slot).agg(F.count(F.lit(1)).alias("all"), F.sum("size").alias("bytes"), F.count_if(F.col("root") != F.col("main")).alias("others"))
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    cells = dealt.join(sizes.filter("others > 0 AND all > 1").select(*slot, blocks), slot)
    cells = cells.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks").cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(*slot, "doc_id", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    given = cells.join(marks.select("doc_id", "hashes", "weights"), "doc_id")
    found = given.groupBy(*slot, "low", "high").applyInArrow(_cell_pairs(threshold), "doc_id long, hub long, similarity double")
    return found.filter(F.col("similarity") >= threshold).dropDuplicates(["doc_id", "hub"])


def near_links(texts: DataFrame, heads: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (doc_id, hub, similarity) among the ``heads`` (doc_id, same) of ``texts``.

    No pair of a bucket stays undecided: its members are joined by links, compared, or too unlike
    by their prefixes.
    """
    banded = texts.filter("bands IS NOT NULL").select("doc_id", "same", "bands").join(heads, ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id"])
    buckets = cut(banded.select("doc_id", F.posexplode("bands").alias("band", "key")))
    pairs = _hub_pairs(buckets)
    company = heads.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    # the texts of all candidates, gathered once for all rounds
    pool = cut(texts.select("doc_id", "same", "words", "codes").join(company, ["doc_id", "same"], "left_semi").drop("same").dropDuplicates(["doc_id"]))
    shared = pairs.select("band", "key", "doc_id")
    fresh = cut(pairs.filter("doc_id <> hub").select(F.greatest("doc_id", "hub").alias("doc_id"), F.least("doc_id", "hub").alias("hub")).distinct())
    links, marks, width, done = cut(verified(fresh, pool, threshold)), None, WIDTH, 0
    opened = _open_buckets(shared, links)
    while True:  # few comparisons join most of a dense bucket; what is left meets in wider slots, at last all
        members = opened.filter(F.col("n") > done)  # buckets of one slot gave all their pairs
        widest = members.agg(F.max("n").alias("n")).first()["n"]
        if widest is None:
            return links
        if marks is None:  # open buckets only become fewer
            marks = cut(pool.join(members.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_marks(threshold), MARKS))
        if width == WIDTH:
            found = verified(_open_pairs(members, marks, width, threshold).join(fresh, ["doc_id", "hub"], "left_anti"), pool, threshold)
        else:
            found = _cell_links(members, marks, width, threshold)
        found = cut(found)
        if not found.isEmpty():
            links = cut(links.unionByName(found))
        if widest <= width:
            return links
        if not found.isEmpty():
            opened = _open_buckets(shared, links)
        done, width = width, width * WIDEN


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, class_id, n_links, kept: one row per doc_id, class_id the smallest doc_id of its class.

    Texts with the same words (case and punctuation aside) are one class without being compared;
    this holds for texts without words too. A text of fewer than five words has one shingle.
    n_links counts the verified links of the document's word sequence. Rows without doc_id cannot be
    told apart and are left out; a repeated doc_id counts once, with one of its texts.
    """
    words = words_of(text_of())
    groups = pieces(total_bytes(docs), group_bytes)
    given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    dealt = given.select("doc_id", F.md5("words").alias("same"), "words", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"))
    codes = cut(document_frequency(dealt.select("g", "words"), groups, docs.count()))
    signed = cut(dealt.groupBy("g").cogroup(codes.groupBy("g")).applyInArrow(_sign(bands, rows), "doc_id long, same string, words string, codes binary, bands array<long>"))
    keyed = cut(signed.groupBy("doc_id").agg(F.min("same").alias("same")))
    firsts = keyed.groupBy("same").agg(F.min("doc_id").alias("first"))
    member = cut(keyed.join(firsts, "same").select("doc_id", "same", "first"))
    links = near_links(signed, member.filter("doc_id = first").select("doc_id", "same"), threshold)
    roots = components(links.select(F.col("doc_id").alias("u"), F.col("hub").alias("v")))
    degree = links.select("doc_id").unionByName(links.select(F.col("hub").alias("doc_id"))).groupBy(F.col("doc_id").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))
    known = roots.join(degree, "node").select(F.col("node").alias("first"), "root", "n_links")
    return member.join(known, "first", "left").select(
        "doc_id", F.coalesce("root", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("doc_id") == F.coalesce("root", "first")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each near-duplicate class; rows without doc_id stay.

    Rows that repeat a kept doc_id are dropped too: one of them stays.
    """
    classes = cut(near_duplicates(docs, threshold).select("doc_id", "kept"))
    gone = classes.filter("NOT kept").select("doc_id")
    rest = docs.join(gone, "doc_id", "left_anti")
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    twice = cut(twice)
    if twice.isEmpty():
        return rest
    return rest.join(twice, "doc_id", "left_anti").unionByName(rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
