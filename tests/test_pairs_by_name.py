"""Names and labels travel to the pairs, not pairs to the names; each age word is sought once."""

import pytest
from pyspark.sql import functions as F

from medloom.functions import fixed_values as fv
from medloom.operators import cleaning, graph, strong_pairs

DOCS = [(i, sorted({f"t{i % 3}", f"t{i % 4}", f"t{i % 5}", "u"})) for i in range(40)]


@pytest.fixture
def no_guess(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_meet_names_and_labels_without_a_shuffle(no_guess):
    rows = no_guess.createDataFrame(DOCS, "row_id int, terms array<string>")
    pairs = strong_pairs.strong_pairs(rows, 1, 0.0)
    assert "SortMergeJoin" not in _plan(pairs)
    want = {(r["a"], r["b"]): (r["co"], round(r["npmi"], 9)) for r in graph.weighted_pairs(rows).where("npmi >= 0").collect()}
    assert {(r["a"], r["b"]): (r["co"], round(r["npmi"], 9)) for r in pairs.collect()} == want


def test_modularity_reads_its_edges_once(no_guess):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 0.5), ("d", "e", 1.5)]
    labels = {"a": 0, "b": 0, "c": 1, "d": 1}  # e stands alone
    got = graph.modularity(no_guess.createDataFrame(edges, "a string, b string, w double"), no_guess.createDataFrame(labels.items(), "term string, cluster_id int"))
    of, m = lambda n: labels.get(n, n), sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        for n in (a, b):
            degree[of(n)] = degree.get(of(n), 0) + w
    want = sum(w for a, b, w in edges if of(a) == of(b)) / m - sum(d * d for d in degree.values()) / (4 * m * m)
    assert abs(got.first()["modularity"] - want) < 1e-12 and "SortMergeJoin" not in _plan(got)


def test_each_age_word_is_sought_once(spark):
    df = spark.createDataFrame([("Neonat or child",), ("12 - 40",), ("60+",), ("any age, infant",), (None,), ("none",)], "t string")
    asked = df.select(cleaning.age_range(F.col("t")).alias("a"))
    pattern = fv.AGE_WORDS[0][0]
    assert asked._jdf.queryExecution().optimizedPlan().toString().count(pattern) == 1
    held = [(lo, hi) for p, lo, hi in fv.AGE_WORDS if any(x in "neonat or child" for x in p.split("|"))]
    got = [tuple(r["a"]) for r in asked.collect()]
    assert got == [(min(lo for lo, _ in held), max(hi for _, hi in held)), (12, 40), (60, 120), (0, 120), (0, 120), (0, 120)]
