"""Models fitted together satisfy their own equations, as plain numpy and SQL see them."""

import duckdb
import fixtures
import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from medloom.operators import association, many_fits, selection
from medloom.operators.quality import contingency, information_from_cells
from medloom.plans import model_plans, standins


def _rows(spark, x, y, w):
    data = [([1.0, *a], float(b), c) for a, b, c in zip(x.tolist(), y.tolist(), w.tolist())]
    return spark.createDataFrame(data, "x array<double>, y double, w array<double>").repartition(3)


def _gradient(x, y, w, beta):
    x = np.column_stack([np.ones(len(x)), x])
    return x.T @ (w * (1 / (1 + np.exp(-(x @ beta))) - y))


@pytest.fixture(scope="module")
def binary():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    x[:, 3] = x[:, 0] + 0.3 * rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))).astype(float)
    return x, y, (rng.random((500, 3)) < [1.0, 0.5, 0.7]).astype(float)


def test_each_model_solves_its_score_equations(spark, binary):
    x, y, w = binary
    used = np.array([[1, 1, 1, 1, 1], [1, 0, 1, 1, 1], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0]], bool)
    sample = [0, 1, 2, 1]
    fit = many_fits.fit_binary(_rows(spark, x, y, w), used, sample)
    for m, s in enumerate(sample):
        g = _gradient(x, y, w[:, s], fit["beta"][m])
        assert np.abs(g[used[m]]).max() < 1e-6 and not fit["beta"][m][~used[m]].any()
    assert fit["beta"][3][0] == pytest.approx(np.log(y[w[:, 1] > 0].mean() / (1 - y[w[:, 1] > 0].mean())))


def test_l1_models_meet_the_optimality_conditions(spark, binary):
    x, y, w = binary
    for l1 in (5.0, 60.0, 1e4):
        fit = many_fits.fit_binary(_rows(spark, x, y, w), np.ones((3, 5), bool), range(3), l1=l1, tolerance=1e-9)
        for m in range(3):
            g, b = _gradient(x, y, w[:, m], fit["beta"][m]), fit["beta"][m]
            assert abs(g[0]) < 1e-5
            for gj, bj in zip(g[1:], b[1:]):
                assert abs(gj + l1 * np.sign(bj)) < 1e-4 if abs(bj) > 1e-8 else abs(gj) <= l1 + 1e-6
        if l1 == 1e4:
            assert not fit["beta"][:, 1:].any()


def test_score_equations_by_sql(spark):
    """The registered model's coefficients, put into DuckDB, leave no score."""
    x, groups = association.design(standins.cohort(spark, SF_DIR), ["segment"], ["age", "c_acctbal"], "outcome")
    effects = {r["term"]: float(np.log(r["odds_ratio"])) for r in association.adjusted_effects(x, groups)[0].collect()}
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    part = {t: f"(segment = '{t.split('=')[1]}')::INT" if "=" in t else "age / 10.0" if t == "age_per_10y" else t for t in effects}
    linear = " + ".join(f"({b!r}) * {part[t]}" for t, b in effects.items())
    # the constant is what makes the residuals add up to nothing: found by bisection in SQL's own numbers
    low, high = -50.0, 50.0
    mean = lambda c: con.execute(f"WITH {standins.COHORT} SELECT sum(outcome - 1 / (1 + exp(-({c!r} + {linear})))) FROM cohort WHERE outcome IS NOT NULL").fetchone()[0]
    for _ in range(70):
        low, high = ((low + high) / 2, high) if mean((low + high) / 2) > 0 else (low, (low + high) / 2)
    for t in effects:
        total, size = con.execute(f"WITH {standins.COHORT} SELECT sum((outcome - 1 / (1 + exp(-({low!r} + {linear})))) * {part[t]}), sum(abs({part[t]})) FROM cohort WHERE outcome IS NOT NULL").fetchone()
        assert abs(total) < 1e-6 * size


def test_softmax_models_solve_their_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 5)).astype(float)
    y = np.clip((x[:, 0] + 2 * x[:, 1] + rng.normal(size=400) * 0.5).round(), 0, 2).astype(int)
    w = (rng.random((400, 2)) < 0.6).astype(float)
    rows = spark.createDataFrame([([1.0, *a], int(b), c) for a, b, c in zip(x.tolist(), y, w.tolist())], "x array<double>, y int, w array<double>").repartition(3)
    used = np.array([[1, 1, 1, 1, 1, 1], [1, 1, 0, 0, 1, 0], [1, 0, 0, 0, 0, 0]], bool)
    sample = [0, 1, 1]
    beta = many_fits.fit_softmax(rows, 3, used, sample, tolerance=1e-8)
    full = np.column_stack([np.ones(400), x])
    for m, s in enumerate(sample):
        z = full @ beta[m]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        ridge = np.ones((6, 1))
        ridge[0] = 0
        g = full.T @ ((p - np.eye(3)[y]) * w[:, [s]]) + ridge * beta[m]
        assert np.abs(g[used[m]]).max() < 1e-4 and not beta[m][~used[m]].any()
    counts = many_fits.confusion(rows, beta, [0, 0, 1])
    for m, s in enumerate([0, 0, 1]):
        want = np.zeros((3, 3))
        np.add.at(want, (y, (full @ beta[m]).argmax(1)), w[:, s])
        assert np.array_equal(counts[m], want)


def test_macro_f1():
    counts = np.array([[[8, 2, 0], [1, 9, 0], [0, 0, 0]], [[0, 5, 0], [0, 5, 0], [0, 0, 0]]], float)
    assert many_fits.macro_f1(counts) == pytest.approx([(16 / 19 + 18 / 21) / 2, (0 + 10 / 15) / 2])


def _answers(n=400, items=10, signal=4, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    rows = []
    for i in range(n):
        row = [int(y[i]) if j < signal and rng.random() < 0.6 else int(rng.integers(0, 3)) for j in range(items)]
        rows.append((i, f"kind{y[i]}", *map(str, row)))
    return rows, [f"item{j}" for j in range(items)]


def test_fold_information_equals_that_of_the_training_rows(spark):
    rows, items = _answers(60, 4)
    df = spark.createDataFrame(rows, ["id", "kind", *items])
    folds = [selection.fold_of(r, 3, F.col("id")) for r in (0, 1)]
    mi, joint = selection.fold_information(df, items, "kind", folds, 3)
    got = {(r["part"], r["feature"]): r["mi"] for r in mi.collect()}
    pairs = {(r["part"], r["f1"], r["f2"]): r["joint_mi"] for r in joint.collect()}
    for part, train in [(0, df), (2, df.where(folds[0] != 1)), (6, df.where(folds[1] != 2))]:
        for r in information_from_cells(contingency(train, items, "kind"), ["feature"]).collect():
            assert got[part, r["feature"]] == pytest.approx(r["mi"])
        for r in selection.pair_information(train, items, "kind").collect():
            assert pairs[part, r["f1"], r["f2"]] == pytest.approx(r["joint_mi"])


def test_questionnaire_reduction_finds_the_planted_items(spark):
    rows, items = _answers()
    df = spark.createDataFrame(rows, ["id", "kind", *items])
    curve = sorted(selection.reduce_questionnaire(df, items, "kind", "id", 3, 1).collect(), key=lambda r: r["k"])
    assert {r["item"] for r in curve[:4]} == set(items[:4]) and {r["item"] for r in curve} == set(items)
    chosen = next(r for r in curve if r["recommended"])
    assert chosen["k"] <= 6 and chosen["mean_accuracy"] >= curve[-1]["mean_accuracy"] - 0.03
    assert all(0 <= r["mean_macro_f1"] <= 1 for r in curve) and curve[3]["mean_accuracy"] > curve[3]["random_mean_accuracy"]


def test_drivers_are_stable_and_pass_the_ratio_test(spark):
    cols = ["id", "age", "family", "exercise", "routine", "sleep", "outcome"]
    df = spark.createDataFrame(fixtures.cohort_rows(), cols)
    x, groups = association.design(df, ["family", "exercise", "routine"], ["age", "sleep", "id"], "outcome")
    groups.pop("id")
    stable = {r["variable"]: r["stability"] for r in association.stability_selection(x, groups, ["id"]).collect()}
    lrt = {r["variable"]: r for r in association.adjusted_effects(x, groups)[1].collect()}
    assert min(stable["age"], stable["family"]) >= 0.9 and max(lrt["age"]["lrt_p"], lrt["family"]["lrt_p"]) < 1e-4
    assert all(lrt[v]["lrt_p"] > 0.001 for v in ("exercise", "routine", "sleep")) and lrt["family"]["dof"] == 2
    assert all(stable[v] < stable["age"] for v in ("exercise", "routine", "sleep"))


def test_whole_questionnaire_query(spark):
    curve = sorted(model_plans.questionnaire_curve(spark, SF_DIR).collect(), key=lambda r: r["k"])
    assert [r["k"] for r in curve] == list(range(1, 26)) and sum(r["recommended"] for r in curve) == 1
    assert curve[-1]["mean_accuracy"] > 0.6
