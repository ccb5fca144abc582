"""SimHash trees, importance resampling and hard negatives against brute force and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest
import xxhash
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medloom.llm import hard_negatives, importance, oracles, queries, runs, simhash
from medloom.plans.base import table

LONG = "".join(random.Random(5).choice(["alpha", "Beta", "gamma-ray", "ünïcode", "x1", "\t", "\n", " "]) + " " for _ in range(60_000))


@pytest.fixture(scope="session")
def odd_texts(spark):
    """Nulls, empty, blank and very long texts, repeated rows and ids, columns with clashing names."""
    rows = [(1, "one two three four five"), (2, "one two three four five"), (2, "one two three four five"), (3, None), (4, ""), (5, " \t\n "), (6, "two words"), (7, LONG), (None, LONG),
            (None, None), (8, "ONE two Three four five"), (9, "äÖ 😀 zeile"), (10, LONG + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("fp", "key", "n", "t", "i", "score", "weight", "rank", "digest", "part", "root", "lead", "side")])


# --- pieces of texts ----------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.text("ab \t\nä", max_size=60), st.integers(0, 3), st.integers(1, 9))
def test_word_lists_hold_every_run_once(text, overlap, size):
    data = text.encode()
    words = data.split()
    got, seen = [], 0
    for part in runs.word_lists(data, overlap, size):
        fresh = min(seen, overlap)
        assert part[:fresh] == words[seen - fresh : seen]
        got += list(runs.joined_runs(part, overlap + 1))
        seen += len(part) - fresh
    assert seen == len(words) and got == [b" ".join(words[i : i + overlap + 1]) for i in range(len(words) - overlap)]


# --- SimHash ------------------------------------------------------------------------------------
def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_classes(fps, radius):
    """Class of each distinct fingerprint, by all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_simhash_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()}
    fps = {d: _plain_fingerprint(t) for d, t in docs.items()}
    classes = _plain_classes(fps.values(), 4)
    lowest = {}
    for d in sorted(docs, reverse=True):
        lowest[classes[fps[d]]] = d
    want = {d: (f"{fps[d]:016x}", lowest[classes[fps[d]]]) for d in docs}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op11_simhash_dedup(spark, SF_DIR).collect()}
    assert got == want


@pytest.mark.parametrize("radius,blocks,shard", [(4, None, 8192), (4, 6, 8192), (4, 7, 16), (3, None, 7), (0, 3, 5), (6, 8, 50)])
def test_links_match_all_pairs_for_any_blocks_and_shards(spark, radius, blocks, shard):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {0, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(100)}
    for c in centres:  # dense balls and chains
        for _ in range(120):
            x = c
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    df = spark.createDataFrame([(_signed(x),) for x in fps], "fp long").repartition(3)
    edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(df, radius, blocks, shard).collect()]
    want = _plain_classes(fps, radius)
    assert all(want[u] == want[v] for u, v in edges)
    got = {f: f for f in fps}
    label = simhash.unite(np.arange(len(fps)), *(np.array([sorted(fps).index(e[i]) for e in edges], np.int64) for i in (0, 1)))
    got = dict(zip(sorted(fps), label.tolist()))
    assert len(set(got.values())) == len(set(want.values()))


def test_tree_search_follows_all_edges_within_the_radius():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64) & np.uint64(0xFFFF))
    unit = np.sort(rng.integers(0, 3, len(fp)))
    forest = simhash.Forest(fp, unit, np.ones(len(fp), bool))
    got = {(int(a), int(b)) for q, n in forest.search(np.arange(len(fp)), unit, 3) for a, b in zip(q, n)}
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if a != b and unit[a] == unit[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert got == want


def test_simhash_odd_rows(odd_texts):
    rows = simhash.near_duplicates(odd_texts).collect()
    assert len(rows) == odd_texts.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[1]["fp"] == got[8]["fp"] and {got[d]["component_id"] for d in (1, 2, 8)} == {1}
    assert {got[d]["component_id"] for d in (3, 4, 5)} == {3} and got[3]["fp"] == 0
    assert got[6]["fp"] == _signed(xxhash.xxh64_intdigest(b"two words", 42))
    assert got[7]["component_id"] == 7 and got[10]["component_id"] == 7
    assert sorted(str(r["component_id"]) for r in rows if r["doc_id"] is None) == ["3", "7"]
    assert got[7]["fp"] == _signed(_plain_fingerprint(LONG))
    assert simhash.near_duplicates(odd_texts.filter("false")).count() == 0
    lone = simhash.near_duplicates(odd_texts.filter("doc_id IS NULL AND text IS NULL")).collect()
    assert [(r["doc_id"], r["component_id"]) for r in lone] == [(None, None)]


# --- importance resampling -----------------------------------------------------------------------
def test_importance_matches_sql(spark):
    got = queries.op12_importance_resampling(spark, SF_DIR).toPandas()
    assert oracle.differences(got, oracle.connect(SF_DIR).execute(oracles.IMPORTANCE).fetchdf()) == ""


def _plain_resample(docs, target, runs_, buckets, percent, least, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, runs_ + 1) for i in range(len(words) - k + 1)]

    own = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for (d, text), (n, f) in zip(docs, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), _signed(xxhash.xxh64_intdigest((text or "").encode(), 42))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[5]))
    drawn = Counter()
    ranked = []
    for i, r in enumerate(able[: percent * len(able) // 100]):
        ranked.append((*r[:5], i + 1))
        drawn[r] += 1
    for r in out:
        if drawn[r]:
            drawn[r] -= 1
        else:
            ranked.append((*r[:5], None))
    return sorted(ranked, key=str)


@pytest.mark.parametrize("options", [(1, 10_000, 10, 20, 2024), (3, 50, 50, 1, 7), (2, 1, 100, 0, 1), (1, 10, 0, 5, 1), (2, 97, 70, 2, 3)])
def test_importance_odd_rows(spark, odd_texts, options):
    runs_, buckets, percent, least, seed = options
    target = spark.createDataFrame([("one two ünïcode",), (None,), ("",)], "text string").withColumn("doc_id", F.lit(1))
    docs = [(r["doc_id"], r["text"]) for r in odd_texts.select("doc_id", "text").collect()]
    got = importance.resample(odd_texts, target, percent, least, runs_, buckets, seed).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=str) == _plain_resample(docs, [r["text"] for r in target.collect()], runs_, buckets, percent, least, seed)


def test_importance_ties_are_cut_by_doc_id(spark):
    """One draw for all rows (null ids) or equal weights: many rows share a score."""
    same = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a b c x"), F.col("id").cast("string")).alias("text"))
    named = spark.range(300).select((F.col("id") % 40).alias("doc_id"), F.lit("a b c").alias("text"))
    for docs in (same, named, named.unionByName(same)):
        plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = importance.resample(docs, docs.limit(0), 35, 1).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted((tuple(r) for r in got), key=str) == _plain_resample(plain, [], 1, 10_000, 35, 1, 2024)


def test_importance_empty_tables_and_documents(spark, odd_texts):
    target = table(spark, SF_DIR, "benchmark")
    assert importance.resample(odd_texts.filter("false"), target).count() == 0
    assert importance.resample(odd_texts, target.filter("false")).count() == odd_texts.count()
    kept = importance.resampled_documents(odd_texts, target, percent=50, least_words=1)
    assert kept.columns == odd_texts.columns and 0 < kept.count() < odd_texts.count()


# --- hard negatives ------------------------------------------------------------------------------
def test_negatives_match_sql(spark):
    got = queries.op13_hard_negatives(spark, SF_DIR).toPandas()
    assert oracle.differences(got, oracle.connect(SF_DIR).execute(oracles.NEGATIVES).fetchdf()) == ""


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 130), st.integers(0, 1000), st.sampled_from([1e-3, 1.0, 1e3, 1e9]))
def test_intervals_hold_the_scores(width, seed, size):
    rng = np.random.default_rng(seed)
    v = hard_negatives.whole(rng.normal(size=(30, width)) * size)
    v[0] = 0
    q = np.concatenate([v[:5], hard_negatives.whole(rng.normal(size=(5, width)) * size)])
    low, high = hard_negatives.intervals(q, hard_negatives.Codes(v))
    exact = q @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low)[0, 0] < 1


def test_codes_leave_out_far_rows():
    """Rows near the query keep, rows far from it lose their chance by their codes alone."""
    rng = np.random.default_rng(1)
    q = hard_negatives.whole(rng.normal(size=(1, 256)))
    near, far = (hard_negatives.whole(a * q / 256 + rng.normal(size=(500, 256)) * b) for a, b in ((1, 0.1), (0, 1)))
    low, _ = hard_negatives.intervals(q, hard_negatives.Codes(near))
    _, high = hard_negatives.intervals(q, hard_negatives.Codes(far))
    assert (high < np.median(0.99 * (near @ q[0]))).mean() > 0.9 and (low < near @ q[0]).all()


def _plain_negatives(rows, every, relabel, positives, negatives, share):
    """All pairs, whole numbers without bounds but a long's ends."""
    kept = []
    for i, (d, vec, label) in enumerate(rows):
        if d is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((i, d, (label + relabel[1]) % relabel[2] if d % relabel[0] == 0 else label, [math.floor(256 * x) for x in vec]))
    out = []
    for i, d, label, v in kept:
        if d % every:
            continue
        found = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), e, j, other) for j, e, other, w in kept if j != i]
        order = sorted(found, key=lambda x: (-x[0], x[1]))
        for score, e, _, _ in [x for x in order if x[3] == label][:positives]:
            fits = [x for x in order if x[3] != label and share[0] * score <= share[1] * x[0] <= share[1] * score][:negatives]
            out += [(d, e, r + 1, x[1], score, x[0]) for r, x in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "ragged"])
def test_negatives_odd_rows(spark, kind):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        vec = rng.normal(size=5) * (1e17 if kind == "huge" else 1.0)
        vec = np.sign(vec) if kind == "ties" else vec
        rows.append((i, vec[: 1 + i % 5].tolist() if kind == "ragged" else vec.tolist(), int(rng.integers(0, 4))))
    rows += [(7, None, 1), (None, rows[1][1], 1), (20, [math.nan] * 5, 1), (20, [math.inf] * 5, 1), (20, [None] * 5, 1), (30, rows[3][1], None), (40, [0.0] * 5, 2), (20, [], 2)]
    rows += [rows[20], rows[21], rows[21]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("uid", "code", "vec", "place", "goals", "cell", "kind", "score", "rank", "align", "other")]).repartition(3)
    for share in ((80, 100), (-200, 100)):
        got = hard_negatives.hard_negatives(df, every=10, relabel=(7, 1, 4), share=share).collect()
        assert sorted(tuple(r) for r in got) == _plain_negatives(rows, 10, (7, 1, 4), 5, 5, share)


def test_negatives_do_not_depend_on_cells(spark, monkeypatch):
    df = table(spark, SF_DIR, "embeddings")
    want = sorted(map(tuple, hard_negatives.hard_negatives(df, relabel=(7, 1, 10)).collect()))
    for name, value in (("BLOCK_BYTES", 64 * 8 * 70), ("QUERIES", 2), ("TILE", 100)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(map(tuple, hard_negatives.hard_negatives(df, relabel=(7, 1, 10)).collect())) == want


def test_negatives_empty_tables(spark):
    df = table(spark, SF_DIR, "embeddings")
    assert hard_negatives.hard_negatives(df.filter("false")).count() == 0
    assert hard_negatives.hard_negatives(df.filter("vec_id % 100 <> 0")).count() == 0
    assert hard_negatives.hard_negatives(df.filter("label = 3")).count() == 0
