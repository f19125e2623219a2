"""Operators that SQL does not check, against brute force and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.operators import claims, features, guardrails, inference, models


def test_shapiro_of_a_published_sample(spark):
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = inference.shapiro(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"]).first()
    assert row["w"] == pytest.approx(0.79, abs=0.005) and row["p"] == pytest.approx(0.0067, abs=0.0005)


def test_shapiro_of_uneven_sizes_and_constants(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), 1.0) for a in rng.exponential(size=400)], "a double, b double")
    got = {r["variable"]: r["p"] for r in inference.shapiro(df, ["a", "b"]).collect()}
    assert got["a"] < 1e-6 and got["b"] == 1.0


def test_power_of_a_known_design():
    assert dist.t_test_power(0.5, 64, 64) == pytest.approx(0.8015, abs=0.001)
    assert dist.t_test_power(0.0, 20, 20) == pytest.approx(0.05, abs=1e-4)
    assert dist.t_test_power(0.5, 1, 20) is None


def test_fisher_of_a_small_table():
    assert dist.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03497, abs=1e-4)
    assert dist.fisher_two_sided(0, 0, 0, 0) is None


def test_bootstrap_interval_is_near_the_analytic_one_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v + 0.4 * (i % 2 == 0)), i % 2) for i, v in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "k long, v double, arm long")
    a, b = (inference.bootstrap_difference(df.repartition(n), "k", "v", "arm", 0, 1, 400).first() for n in (1, 3))
    assert a["low"] == pytest.approx(b["low"], abs=1e-9)
    assert a["low"] < a["d"] < a["high"] and a["high"] - a["low"] == pytest.approx(4 * math.sqrt(2 / 200), rel=0.2)
    assert inference.bootstrap_difference(df, "k", "v", "arm", 0, 1, 10, most=100).first()["low"] is None


def test_bootstrap_and_normality_do_their_work_on_large_tables(spark):
    rng = np.random.default_rng(4)
    v = 1000 + rng.normal(size=8000) + 0.4 * (np.arange(8000) % 2 == 0)
    df = spark.createDataFrame([(i, float(x), i % 2, float(rng.exponential()) if i < 300 else None, 1.0, None) for i, x in enumerate(v)], "k long, v double, arm long, few double, same double, none double")
    x, y = v[::2], v[1::2]
    d = (x.mean() - y.mean()) / math.sqrt((x.var() + y.var()) * 4000 / 7998)
    row = inference.bootstrap_difference(df, "k", "v", "arm", 0, 1, 400).first()
    assert row["n"] == 8000 and row["d"] == pytest.approx(d)
    assert row["low"] < d < row["high"] and row["high"] - row["low"] == pytest.approx(4 * math.sqrt(2 / 4000), rel=0.2)
    row = inference.bootstrap_difference(df, "k", "v", "arm", 0, 1, 10, most=100).first()
    assert row["d"] == pytest.approx(d) and row["low"] is None
    got = {r["variable"]: r for r in inference.normality(df, ["v", "few", "same", "none"]).collect()}
    k2, w = inference.dagostino(df, ["v"]).first(), inference.shapiro(df, ["few"]).first()
    assert (got["v"]["test"], got["v"]["n"], got["v"]["w"]) == ("dagostino", 8000, None) and (got["v"]["k2"], got["v"]["p"]) == pytest.approx((k2["k2"], k2["p"]))
    assert (got["few"]["test"], got["few"]["n"], got["few"]["k2"]) == ("shapiro", 300, None) and (got["few"]["w"], got["few"]["p"]) == pytest.approx((w["w"], w["p"]))
    assert (got["same"]["n"], got["same"]["p"]) == (8000, None) and (got["none"]["n"], got["none"]["test"], got["none"]["p"]) == (0, None, None)


def _cox_brute(t, e, x, beta):
    like = 0.0
    for s in np.unique(t[e == 1]):
        dead, risk = (t == s) & (e == 1), t >= s
        r = np.exp(x @ beta)
        like += (x[dead] @ beta).sum()
        for k in range(dead.sum()):
            like -= math.log(r[risk].sum() - k / dead.sum() * r[dead].sum())
    return like


def test_cox_maximises_the_tied_likelihood(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    t = np.ceil(rng.exponential(np.exp(-0.7 * x[:, 0])) * 5)
    e = (rng.random(150) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "t double, e int, x double, y double")
    got = models.cox(df, "t", "e", ["x", "y"]).collect()
    beta = np.array([r["coef"] for r in got])
    x = x - x.mean(axis=0)
    best = _cox_brute(t, e, x, beta)
    assert got[0]["log_likelihood"] == pytest.approx(best, abs=1e-6)
    assert all(_cox_brute(t, e, x, beta + d) < best for d in 0.01 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1]]))
    assert beta[0] == pytest.approx(0.7, abs=0.3)


def test_logistic_meets_its_score_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-0.5 - x))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double")
    got = {r["term"]: r["coef"] for r in models.logistic(df, "y", ["x"]).collect()}
    p = 1 / (1 + np.exp(-got["intercept"] - got["x"] * x))
    assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * x).sum()) < 1e-6
    with pytest.raises(ValueError):
        models.logistic(df.withColumn("y", (F.col("x") > 0).cast("int")), "y", ["x"])


def test_interaction_is_the_f_of_nested_least_squares(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, 200), rng.integers(0, 3, 200)
    y = rng.normal(size=200) + a * (b == 2)
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(a, b, y)], "a int, b int, y double")
    one = np.column_stack([np.ones(200), a, b == 1, b == 2]).astype(float)
    two = np.column_stack([one, a * (b == 1), a * (b == 2)])
    rss = [float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()) for m in (one, two)]
    got = inference.interaction(df, "y", "a", "b").first()
    assert (got["df1"], got["df2"]) == (2, 194)
    assert got["f"] == pytest.approx((rss[0] - rss[1]) / 2 / (rss[1] / 194), rel=1e-6)


def test_lasso_meets_its_optimality_conditions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=500)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k long, a double, b double, c double, d double, e double, y double")
    got = {r["variable"]: r for r in features.elastic_net(df, "k", "y", list("abcde"), size=2).collect()}
    assert {c for c in got if got[c]["selected"]} == {"a", "b"} and got["a"]["coef"] > 0 > got["b"]["coef"]
    z, w = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    beta = np.array([got[c]["coef"] for c in "abcde"])
    slope = z.T @ (w - z @ beta) / 500
    strength = abs(slope[beta != 0]).max()
    assert np.allclose(abs(slope[beta != 0]), strength, atol=1e-6) and (abs(slope) <= strength + 1e-6).all()


def test_mrmr_equals_a_dense_version(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    x = np.column_stack([y + rng.normal(size=400) * s for s in (0.5, 0.7, 1.0, 3.0, 9.0)])
    x[:, 1] = x[:, 0] + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y, x)], "y int, a double, b double, c double, d double, e double")
    mi = []
    for v in x.T:
        bins = (np.quantile(v, [k / 10 for k in range(1, 10)])[None, :] < v[:, None]).sum(1)
        table = np.array([[((bins == i) & (y == j)).mean() for j in (0, 1)] for i in range(10)])
        part = table * np.log(np.where(table > 0, table, 1) / (table.sum(1, keepdims=True) * table.sum(0, keepdims=True)))
        mi.append(part[table > 0].sum())
    rel, r, want = (np.array(mi) - min(mi)) / np.ptp(mi), np.abs(np.corrcoef(x.T)), []
    while len(want) < 4:
        score = {j: rel[j] - (np.mean([r[j, k] for k in want]) if want else 0) for j in range(5) if j not in want}
        want.append(max(score, key=score.get))
    assert [r["variable"] for r in features.mrmr(df, "y", list("abcde"), 4).orderBy("rank").collect()] == ["abcde"[j] for j in want]


def test_pairs_are_greedy_and_one_to_one(spark):
    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gamma", "delta", "zeta"]
    make = lambda n: [(i, int(rng.integers(3)), " ".join(rng.choice(words, 3))) for i in range(n)]
    left, right = make(12), make(9)
    score = lambda p, q: round(0.5 + 0.5 * len(set(p.split()) & set(q.split())) / max(len(set(p.split())), len(set(q.split()))), 6)
    want, used = set(), (set(), set())
    for s, i, j in sorted(((-score(p, q), i, j) for i, g, p in left for j, h, q in right if g == h)):
        if i not in used[0] and j not in used[1]:
            want.add((i, j, -s))
            used[0].add(i), used[1].add(j)
    got = claims.pair(spark.createDataFrame(left, "a long, g int, s string"), "a", "s", spark.createDataFrame(right, "b long, g int, u string"), "b", "u", "g")
    assert {tuple(r) for r in got.collect()} == want


def test_pairs_end_on_large_ties_and_on_keys_of_several_topics(spark):
    kind = lambda k: f"{k} long, g int, s string"
    left, right = [(i, 1, "same words") for i in range(70)] + [(None, 1, "same words"), (900, None, "same"), (901, 1, None), (902, 3, "x1")], [(i, 1, "same words") for i in range(1000, 1090)]
    got = claims.pair(spark.createDataFrame(left, kind("a")), "a", "s", spark.createDataFrame(right, kind("b")), "b", "s", "g")
    assert {tuple(r) for r in got.collect()} == {(i, 1000 + i, 1.0) for i in range(70)}
    left, right = [(1, 1, "aa bb"), (1, 2, "cc dd"), (2, 2, "cc ee"), (2, 3, "gg hh")], [(5, 1, "aa zz"), (6, 2, "cc dd"), (7, 3, "qq rr")]
    got = claims.pair(spark.createDataFrame(left, kind("a")), "a", "s", spark.createDataFrame(right, kind("b")), "b", "s", "g")
    assert {tuple(r) for r in got.collect()} == {(1, 6, 1.0), (2, 7, 0.5)}


def test_stratified_sample_holds_every_stratum(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 5, "rare").when(F.col("id") < 8, None).otherwise("common"))
    got = {r["s"]: r["count"] for r in guardrails.stratified_sample(df, "id", "s", 100).groupBy("s").count().collect()}
    assert got["common"] == 99 and got["rare"] == 1 and got[None] == 1


def test_claims_of_adjusted_models_are_not_verified(spark):
    df = spark.createDataFrame([("Age independently associated with death, p<0.01", "<", 0.01, True, 0.001, None), (None, None, None, None, None, None)], "claim string, p_operator string, p_value double, significant boolean, p double, way string")
    assert [r["verdict"] for r in claims.verdict(df, "claim", "p", "way").collect()] == ["not_verifiable", "unsupported"]


def test_empty_tables_give_empty_or_null_results(spark):
    df = spark.createDataFrame([], "k long, g string, a double, b double")
    assert inference.kendall(df, "a", "b").first()["tau"] is None
    assert inference.dagostino(df, ["a"]).count() == 0 and inference.shapiro(df, ["a"]).count() == 0
    assert guardrails.boxplot(df, "a", "g").count() == 0 and guardrails.range_violations(df.withColumnRenamed("a", "age")).count() == 0
    assert claims.split_claims(df, "k", "g").count() == 0
