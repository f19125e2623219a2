"""Evaluation and interaction against dense versions."""

import numpy as np
import pytest

from cohortlake.functions import distributions as dist
from cohortlake.operators import evaluation, inference


def made(spark, n=600):
    r = np.random.default_rng(8)
    a, b, c = r.normal(size=n), r.normal(size=n), r.choice(["u", "v", "w"], n)
    y = (r.random(n) < 1 / (1 + np.exp(-(1.5 * a + (c == "w"))))).astype(int)
    z = 2 * a - b + r.normal(size=n)
    rows = [(i, float(a[i]) if i % 11 else None, float(b[i]), str(c[i]), int(y[i]), float(z[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id int, a double, b double, c string, y int, z double").repartition(3), rows


def test_evaluation(spark):
    df, rows = made(spark)
    whole = evaluation.split(df, "id", "y")
    held = {r.id: r.held_out for r in whole.collect()}
    again = {r.id: r.held_out for r in evaluation.split(df.repartition(7), "id", "y").collect()}
    assert held == again and all(0.2 <= np.mean([held[r[0]] for r in rows if r[4] == k]) < 0.22 for k in (0, 1))
    out = np.array([held[r[0]] for r in rows])
    code = {"u": 0, "v": 1, "w": 2}
    x = np.array([[np.nan if r[1] is None else r[1], r[2], code[r[3]]] for r in rows])
    x = (x - np.nanmean(x[~out], 0)) / np.nanstd(x[~out], 0)
    x = np.column_stack([np.ones(len(x)), np.nan_to_num(x)])
    y, z = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    beta, ridge = np.zeros(4), np.diag([0.0, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x[~out] @ beta))
        beta += np.linalg.solve((x[~out].T * (p * (1 - p))) @ x[~out] + ridge, x[~out].T @ (y[~out] - p) - ridge @ beta)
    score = x[out] @ beta
    got = evaluation.evaluate(whole, "y", ["a", "b", "c"])
    pos, neg = score[y[out] == 1], score[y[out] == 0]
    assert got["n_test"] == out.sum() and got["accuracy"] == pytest.approx(np.mean((score > 0) == (y[out] == 1)))
    assert got["auc"] == pytest.approx(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)), abs=1e-3)
    w = np.linalg.lstsq(x[~out], z[~out], rcond=None)[0]
    gap = z[out] - x[out] @ w
    reg = evaluation.evaluate(whole, "z", ["a", "b", "c"], "regression")
    assert reg["mse"] == pytest.approx(np.mean(gap**2)) and reg["r2"] == pytest.approx(1 - np.mean(gap**2) / z[out].var())
    with pytest.raises(ValueError):
        evaluation.evaluate(whole, "y", [])


def test_no_stratum_makes_a_task(spark, monkeypatch):
    df, rows = made(spark)
    held = {r.id: r.held_out for r in evaluation.split(df, "id", "y").collect()}
    plan = evaluation.split(df, "id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_s" not in plan  # rows stay where they are
    monkeypatch.setattr(evaluation, "MOST_STRATA", 0)
    assert {r.id: r.held_out for r in evaluation.split(df, "id", "y").collect()} == held
    lost = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(300)], "id int, y int")
    assert evaluation.split(lost, "id", "y").count() == 300


def test_auc_with_ties(spark):
    rows = [(0.1, False), (0.5, True), (0.5, False), (0.9, True), (0.9, True), (0.1, False)]
    assert evaluation.auc(spark.createDataFrame(rows, "s double, p boolean"), "s", "p") == pytest.approx((3 * 2 + 2 + 0.5) / 9)
    assert evaluation.auc(spark.createDataFrame([(0.1, True)], "s double, p boolean"), "s", "p") is None


def test_comparison(spark):
    df, _ = made(spark)
    got = {r.method: r for r in evaluation.compare(df, "id", "y", ["a", "b"], ("univariate", "mrmr", "none", "other"), size=1).collect()}
    assert got["univariate"].features == "a" == got["mrmr"].features and got["none"].n_features == 2 and got["none"].redundancy < 0.2
    assert got["univariate"].auc == got["mrmr"].auc > 0.7 and got["other"].error and len({r.n_test for m, r in got.items() if m != "other"}) == 1


def dense(cells):
    """Likelihood ratio of cells (level, arm, n, y): saturated less additive logit, by Newton on dummies."""
    levels, arms = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    x = np.array([[float(c[0] == v) for v in levels] + [float(c[1] == v) for v in arms[1:]] for c in cells])
    n, y = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], float)
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.pinv((x.T * (n * p * (1 - p))) @ x) @ x.T @ (y - n * p)
    like = lambda p: float(np.sum(np.where(y > 0, y * np.log(np.maximum(p, 1e-300)), 0) + np.where(n > y, (n - y) * np.log(np.maximum(1 - p, 1e-300)), 0)))
    return 2 * (like(y / n) - like(1 / (1 + np.exp(-x @ beta)))), len(cells) - x.shape[1]


@pytest.mark.parametrize("arms,levels", [(2, 4), (3, 30)])
def test_binary_interaction(spark, arms, levels):
    r = np.random.default_rng(arms)
    rows = [(int(r.random() < 0.2 + 0.2 * a + 0.02 * (l % 7) + 0.1 * (a * l % 2)), a, l) for l in range(levels) for a in range(arms) for _ in range(r.integers(8, 20))]
    rows += [(1, 0, 900), (1, 1, 900), (0, 0, 901), (None, 0, 1), (1, None, 1)]  # levels of one outcome only, and nulls
    df = spark.createDataFrame(rows, "y int, a int, l int")
    cells = {}
    for y, a, l in rows:
        if None not in (y, a) and l < 900:
            n, k = cells.get((l, a), (0, 0))
            cells[l, a] = (n + 1, k + y)
    lr, free = dense([(l, a, n, k) for (l, a), (n, k) in cells.items()])
    got = inference.binary_interaction(df, "y", "a", "l").first()
    assert (got.lr, got.df, got.levels) == (pytest.approx(lr, rel=1e-6), free, levels) and got.p == pytest.approx(dist.chi2_sf(lr, free), rel=1e-5)
    assert inference.binary_interaction(df.filter("l = 0"), "y", "a", "l").first().p is None
