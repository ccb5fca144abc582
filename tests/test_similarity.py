"""Similarity joins against all pairs, tails against whole sums, digests against hashlib."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medloom.functions import stats
from medloom.operators import similarity
from medloom.sources import readers


def _vectors(spark, words, lo=2, hi=3):
    grams = similarity.char_grams(spark.createDataFrame([(w,) for w in words], "term string"), "term", lo, hi, boundaries=True)
    weights = similarity.gram_weights(grams, spark.createDataFrame([(len(set(words)),)], "n long"))
    return similarity.unit_vectors(grams, weights, sublinear=True).cache()


def _plain(left, right):
    """All products of two sets of vectors."""
    def maps(rows):
        out = {}
        for r in rows:
            out.setdefault(r["term"], {})[r["gram"]] = r["w"]
        return out
    one, two = maps(left.collect()), maps(right.collect())
    return {(a, b): sum(w * y.get(g, 0.0) for g, w in x.items()) for a, x in one.items() for b, y in two.items()}


def _words(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["pain", "ache", "head", "stomach", "burn", "ing", "dry", "skin", "of", "the", "s"]
    return sorted({"".join(rng.choice(parts, rng.integers(1, 4))) + " " + "".join(rng.choice(parts, rng.integers(1, 3))) for _ in range(n)})


@pytest.mark.parametrize("threshold", [0.4, 0.8])
@pytest.mark.parametrize("entries", [3, 2_000])
def test_pairs_are_those_of_all_products(spark, threshold, entries):
    vectors = _vectors(spark, _words(150, 1))
    want = {k: v for k, v in _plain(vectors, vectors).items() if k[0] < k[1] and v >= threshold}
    got = {(r["a"], r["b"]): r["score"] for r in similarity.similar_pairs(vectors, threshold, entries=entries).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("entries", [2, 2_000])
def test_pairs_within_blocks(spark, entries):
    vectors = _vectors(spark, _words(120, 2))
    block = vectors.select("term", F.substring("term", 1, 1).alias("block")).distinct()
    want = {k for k, v in _plain(vectors, vectors).items() if k[0] < k[1] and v >= 0.5 and k[0][0] == k[1][0]}
    got = {(r["a"], r["b"]) for r in similarity.similar_pairs(vectors, 0.5, block, entries).collect()}
    assert want and got == want


@pytest.mark.parametrize("entries", [2, 2_000])
def test_reference_pairs_are_those_of_all_products(spark, entries):
    words = _words(160, 3)
    vectors = _vectors(spark, words)
    here, there = (vectors.where(F.pmod(F.xxhash64("term"), F.lit(3)) == 0), vectors.where(F.pmod(F.xxhash64("term"), F.lit(3)) != 0))
    want = {k for k, v in _plain(here, there).items() if v >= 0.45}
    got = {(r["query"], r["term"]) for r in similarity.similar_to_reference(here, there, 0.45, entries).collect()}
    assert want and got == want


def test_no_terms_and_no_grams(spark):
    vectors = _vectors(spark, ["", "a"])
    assert similarity.similar_pairs(vectors.limit(0), 0.5).count() == 0
    assert similarity.similar_to_reference(vectors, vectors.limit(0), 0.5).count() == 0


def test_a_gram_of_many_entries_is_dealt_over_cells(spark):
    heads = spark.range(900).select(F.col("id").cast("string").alias("term"), F.lit("aa").alias("gram"), F.lit(1.0).alias("norm"), F.lit(1.0).alias("total"), F.lit(1.0).alias("top"))
    left, right = similarity._self_cells(heads, ["gram"], 100)
    cells = left.groupBy("_row", "_column").count().collect()
    assert len(cells) == 45 and max(r["count"] for r in cells) < 200
    met = similarity._met(left, right, ["gram"], 0.5).where("l._row < l._column OR l.term < r.term")
    pairs = met.select(F.least("l.term", "r.term").alias("a"), F.greatest("l.term", "r.term").alias("b"))
    assert pairs.count() == pairs.distinct().count() == 900 * 899 // 2


def test_tail_equals_the_whole_sum():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(2, 400))
        r, c = (int(v) for v in rng.integers(0, n + 1, 2))
        a = int(rng.integers(0, min(r, c) + 2))
        want = sum(math.comb(r, k) * math.comb(n - r, c - k) for k in range(max(a, r + c - n, 0), min(r, c) + 1)) / math.comb(n, c)
        assert stats._overlap_tail(a, r, c, n) == pytest.approx(want, rel=1e-9, abs=1e-12), (a, r, c, n)


def test_tail_of_a_billion_rows_is_quick_and_near_the_normal():
    import time

    n, r, c = 1e9, 4e8, 5e8
    mean = r * c / n
    sd = math.sqrt(mean * (1 - c / n) * (n - r) / (n - 1))
    began = time.time()
    for z in (-4.0, -1.0, 0.0, 1.0, 4.0):
        a = round(mean + z * sd)
        assert stats._overlap_tail(a, r, c, n) == pytest.approx(0.5 * math.erfc((a - 0.5 - mean) / sd / math.sqrt(2)), rel=2e-3)
    assert time.time() - began < 2


def test_tail_in_a_frame(spark):
    rows = spark.createDataFrame(pd.DataFrame({"a": [3, 0], "r": [5, 5], "c": [4, 4], "n": [10, 10]}))
    got = [r[0] for r in rows.select(stats.hypergeometric_tail("a", "r", "c", "n")).collect()]
    assert got == pytest.approx([(10 * 5 + 5) / 210, 1.0])


def test_files_beyond_the_binary_limit_stream(spark, tmp_path):
    paths = []
    for name, size in (("a.bin", 0), ("b b.bin", 10), ("c.bin", 100_000), ("d.bin", 70_001)):
        (tmp_path / name).write_bytes(np.random.default_rng(size).bytes(size))
        paths.append(str(tmp_path / name))
    show = lambda df: {(r["path"].rsplit("/", 1)[-1].replace("%20", " "), r["bytes"], r["sha256"]) for r in df.collect()}
    want = {(p.rsplit("/", 1)[-1], len(b := open(p, "rb").read()), hashlib.sha256(b).hexdigest()) for p in paths}
    assert show(readers.file_digests(spark, paths)) == want
    assert show(readers.file_digests(spark, paths, whole=5, chunk=4_096)) == want
    assert show(readers.file_digests(spark, paths, whole=70_001, chunk=1_000)) == want
