"""Numbers that are hashes, numbers that are joined, and names that take no part in a fold."""

import random

from pyspark.sql import functions as F

from medloom.operators import skew
from medloom.operators import vocabulary as v

random.seed(4)
WORDS = ["pain", "pains", "cough", "coughs", "fever", "rash", "rashes", "itch", "itches", "numb toes", "numb toe", "dry cough at night", "left sided pain after meals"]
ROWS = [(d, p, " ".join(random.sample(WORDS, random.randint(1, 3)))) for d in range(60) for p in range(4)] + [(d, 9, random.choice(WORDS)) for d in range(60)] + [(1, 0, "pain"), (1, 5, "pain")]


def tables(spark):
    long = spark.createDataFrame(ROWS, "doc int, pos int, term string")
    vocab = v.fit_vocabulary(long, merge_similar=False)
    other = spark.createDataFrame([*ROWS, (1, 7, "never seen"), (2, 8, None)], "doc int, pos int, term string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    return vocab, [rows(x) for x in (vocab.mapping, vocab.terms, vocab.frequent, vocab.aliases(), v.apply_vocabulary(other, vocab), v.vocabulary_dimension(vocab))]


def test_terms_of_one_hash_are_kept_apart(spark, monkeypatch):
    vocab, want = tables(spark)
    assert vocab.hashed and vocab.names.where(F.col("id") != F.xxhash64("term")).isEmpty()
    monkeypatch.setattr(v, "_number", lambda term: F.length(term).cast("long"))
    clashing, got = tables(spark)
    assert not clashing.hashed
    assert got == want and all(want)


def test_only_folded_terms_are_counted_again(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(v, "lookup", lambda left, dim, key, *a, f=v.lookup: counted.append(sorted({r["id"] for r in left.select("id").collect()})) or f(left, dim, key, *a))
    names = spark.createDataFrame([(1, "rash", 2), (2, "rashes", 1), (3, "cough", 2), (4, "fever", 1)], "id long, term string, df long")
    coded = spark.createDataFrame([(7, 1), (8, 1), (8, 2), (7, 3), (9, 3), (9, 4)], "doc int, id long")
    step = spark.createDataFrame([(2, 1)], "id long, cid long")
    got = sorted(tuple(r) for r in v._folded(names, coded, step).collect())
    assert got == [(1, "rash", 2), (3, "cough", 2), (4, "fever", 1)]
    assert counted == [[1, 2]]


def test_rows_are_either_maybe_known_or_surely_unknown(spark):
    left = spark.createDataFrame([(i,) for i in [*range(500), None, 3]], "id long")
    dim = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "id long")
    near, far = skew.maybe_known(left, dim, "id"), skew.maybe_known(left, dim, "id", known=False)
    values = lambda df: sorted(r["id"] if r["id"] is not None else -1 for r in df.collect())
    assert sorted(values(near) + values(far)) == values(left)
    assert far.join(dim, "id").isEmpty()
