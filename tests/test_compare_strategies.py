"""Four ways to pick questions, all folds and budgets at once, against a brute-force naive Bayes."""

import zlib
from itertools import combinations

import numpy as np
import pytest

from medloom.operators import bayes, selection
from medloom.plans import catalog, model_plans

FOLDS, BUDGETS, SEED = 3, (1, 3, 4, 9), 7
CLUSTERS = {"a0": 0, "a1": 0, "b0": 1, "b1": 1, "x": -1}


def planted(n=90):
    rng = np.random.default_rng(2)
    labels = [(i, "abc"[i % 3]) for i in range(n)]
    cells = [(i, t) for i, y in labels for t in ("a0", "a1", "b0", "b1", "x") if rng.random() < (0.7 if t[0] == y else 0.25)]
    return labels, cells


def information(x, y):
    total = 0.0
    for a in set(x):
        for b in set(y):
            n = sum(1 for p, q in zip(x, y) if (p, q) == (a, b))
            if n:
                total += n / len(x) * np.log(n * len(x) / (x.count(a) * y.count(b)))
    return total


def brute(labels, cells, fold):
    has = {i: {t for j, t in cells if j == i} for i, _ in labels}
    out = {}
    for f in range(FOLDS):
        train, test = [(i, y) for i, y in labels if fold[i] != f], [(i, y) for i, y in labels if fold[i] == f]
        y = [v for _, v in train]
        names = sorted({t for i, _ in train for t in has[i]})
        column = {t: [t in has[i] for i, _ in train] for t in names}
        mi = {t: information(column[t], y) for t in names}
        joint = {p: information(list(zip(column[p[0]], column[p[1]])), y) for p in combinations(names, 2)}
        often = {t: sum(column[t]) for t in names}
        sizes = {c: sum(1 for t in CLUSTERS if CLUSTERS[t] == c) for c in set(CLUSTERS.values())}
        ranked = sorted(names, key=lambda t: (-round(mi[t], 9), t))
        turn = {t: sum(CLUSTERS[u] == CLUSTERS[t] for u in ranked[: ranked.index(t)]) for t in names}
        orders = {"jmi": selection.greedy_order(mi, joint, names, max(BUDGETS)), "frequency": sorted(names, key=lambda t: (-often[t], t)),
                  "cluster_guided": sorted(names, key=lambda t: (CLUSTERS[t] < 0, turn[t] if CLUSTERS[t] >= 0 else 0, -sizes[CLUSTERS[t]], CLUSTERS[t], turn[t])),
                  "random": sorted(names, key=lambda t: zlib.crc32(f"{SEED}:{f}:{t}".encode()))}
        for kind, order in orders.items():
            for b in BUDGETS:
                hits = []
                for i, label in test:
                    z = {}
                    for c in set(y):
                        rows = [j for j, v in train if v == c]
                        theta = {t: (sum(t in has[j] for j in rows) + 1) / (len(rows) + 2) for t in order[:b]}
                        z[c] = np.log(len(rows) / len(train)) + sum(np.log(theta[t] if t in has[i] else 1 - theta[t]) for t in theta)
                    hits.append(sorted(z, key=lambda c: (-round(z[c], 9), c))[0] == label)
                out.setdefault((kind, b), []).append(np.mean(hits))
    return {k: float(np.mean(v)) for k, v in out.items()}


def tables(spark, labels, cells):
    return (spark.createDataFrame(cells, "row_id int, term string"), spark.createDataFrame(labels, "row_id int, label string"),
            spark.createDataFrame(list(CLUSTERS.items()), "term string, cluster_id int"))


def test_all_models_are_scored_together_and_equal_brute_force(spark, monkeypatch):
    labels, cells = planted()
    calls = []
    monkeypatch.setattr(bayes, "score_cases", lambda *a, f=bayes.score_cases, **k: calls.append(1) or f(*a, **k))
    given = tables(spark, labels, [*cells, (3, None), (1000, "a0")])  # a null term and a row without a label take no part
    got = {(r["strategy"], r["budget"]): r for r in selection.compare_strategies(*given, BUDGETS, FOLDS, SEED).collect()}
    fold = {r["row_id"]: r["f"] for r in given[1].select("row_id", selection.fold_of(SEED, FOLDS, given[1]["row_id"]).alias("f")).collect()}
    want = brute(labels, cells, fold)
    assert set(got) == set(want) and len(want) == 16
    assert all(got[k]["top1"] == pytest.approx(v) for k, v in want.items())
    assert all(r["top3"] == pytest.approx(1.0) for r in got.values())  # three classes
    assert len(calls) == 1


def test_equal_rows_count_as_often_as_they_occur(spark):
    labels, cells = planted(30)
    twice = [(i + 1000 * k, y) for k in range(2) for i, y in labels]
    given = tables(spark, twice, [(i + 1000 * k, t) for k in range(2) for i, t in cells])
    folds = given[1].select(selection.fold_of(SEED, 2, given[1]["row_id"]).alias("f")).groupBy("f").count().collect()
    assert len(folds) == 2
    shares = selection.compare_strategies(*given, (2,), 2, SEED).collect()
    assert len(shares) == 4 and all(0 < r["top1"] <= 1 for r in shares)


def test_query_runs_all_budgets_and_folds(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(model_plans.sel, "compare_strategies", lambda cells, labels, clusters, budgets, folds=5, seed=42: asked.update(budgets=budgets, folds=folds))
    catalog.QUERIES["compare_strategies"](spark, "/root/testdata/sf0.001")
    assert asked == {"budgets": (5, 10, 20, 30, 40, 60), "folds": 5}
