"""Numbered terms, places that carry no text, and the bitmap that spares the shuffle."""

import random

from pyspark.sql import functions as F

from medloom.functions.text import split_mentions, tidy_phrase
from medloom.operators import skew, vocabulary


def test_bitmap_keeps_every_known_key(spark):
    left = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    dim = spark.range(0, 20_000, 40).select(F.concat(F.lit("k"), "id").alias("key"))
    kept = skew.maybe_known(left, dim, "key")
    assert kept.columns == left.columns
    assert kept.join(dim, "key", "left_semi").count() == 500 and kept.count() < 1_000
    assert skew.maybe_known(left, dim.where("false"), "key").count() == 0


def test_lookup_by_number_spreads_heavy_keys(spark):
    left = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(50)] + [(99, None)], "doc int, id long")
    dim = spark.createDataFrame([(i, -i, 1) for i in range(0, 20, 2)], "id long, v long, w int")
    got = {(r["doc"], r["v"]) for r in skew.lookup(left, dim, "id", ["v"], "w", F.col("doc")).collect()}
    assert got == {(i, 0 if i % 2 else -i if i < 20 else None) for i in range(50)} | {(99, None)}


def _plain(rows):
    df = {}
    for d, t in set(rows):
        df[t] = df.get(t, 0) + 1
    at = {}
    for t in df:
        tries = ([t[:-2]] if t.endswith("es") else []) + ([t[:-1]] if t.endswith("s") else [])
        at[t] = next((s for s in tries if df.get(s, 0) >= df[t]), t)
    held = {}
    for d, t in rows:
        held.setdefault(at[t], set()).add(d)
    frequent = {c for c, d in held.items() if len(d) >= 3}
    head = {}
    for c in set(held) - frequent:
        w = c.split(" ")
        spans = [(n, -i, " ".join(w[i : i + n])) for i in range(len(w)) for n in range(1, min(len(w) - i, len(w) - 1) + 1)]
        found = [s for s in spans if s[2] in frequent]
        if found:
            head[c] = max(found)[2]
    return {t: (head.get(c, c), "backoff" if c in head else "merge" if c != t else "same") for t, c in at.items()}


def test_numbered_vocabulary_matches_plain_rules(spark):
    rng = random.Random(5)
    words = ["ache", "aches", "ear", "left", "node", "nodes", "skin", "pain"]
    rows = [(d, " ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 5, 9])))) for d in range(400) for _ in range(2)]
    rows += [(d, "one two three four five") for d in range(3)] + [(900, "zero one two three four five six"), (901, "one two three four six")]
    vocab = vocabulary.fit_vocabulary(spark.createDataFrame(rows, "doc int, term string"), merge_similar=False)
    assert {r["term"]: (r["canonical"], r["method"]) for r in vocab.mapping.collect()} == _plain(rows)
    assert dict(vocab.codes.dtypes)["cid"] == "bigint" and "term" not in vocab.codes.columns


def test_a_long_phrase_costs_its_words(spark):
    """Each place of a phrase used to carry the whole phrase: gigabytes for this one."""
    phrase = " ".join(f"w{i}" for i in range(20_000))
    rows = [(d, "w7 w8") for d in range(3)] + [(9, phrase)]
    vocab = vocabulary.fit_vocabulary(spark.createDataFrame(rows, "doc int, term string"), merge_similar=False)
    assert {r["term"]: r["canonical"] for r in vocab.mapping.collect()} == {"w7 w8": "w7 w8", phrase: "w7 w8"}


def test_mentions_tidy_each_phrase_once(spark):
    df = spark.createDataFrame([(1, "Severe  OEDEMA and diarrhoea\t withanda band, with ſkin ΣΑΣ x y; ßweet (and) rash")], "d int, t string")
    parts = [r["p"] for r in df.select(F.explode(F.transform(split_mentions(F.col("t")), tidy_phrase)).alias("p")).collect()]
    assert parts == ["edema", "diarrhea withanda band", "", "skin x y", "ssweet rash"]
    plan = vocabulary.mentions(df, "d", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 12  # each pattern once
