"""The whole analysis by kind of outcome, against direct computations."""

import math

import numpy as np
import pytest

from cohortlake.functions import distributions as dist
from cohortlake.operators import analysis, models
from cohortlake.operators.roles import levels


def made(spark, arms=2, n=240, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        arm, age = "abc"[i % arms], float(r.normal(50, 9))
        y = age / 10 + (arm != "a") * 1.2 + float(r.normal())
        rows.append((i, arm, age, y, int(r.random() < (0.6 if arm == "a" else 0.3)), r.choice(["x", "y"]).item(), int(r.random() < 0.5), float(r.normal()) if r.random() < (0.95 if age < 55 else 0.4) else None))
    return spark.createDataFrame(rows, "id int, arm string, age double, score double, cured int, centre string, smoker int, marker double"), rows


def test_continuous_with_imputation(spark, tmp_path):
    df, rows = made(spark)
    work = analysis.Analysis(df.drop("cured", "smoker"), analysis.Plan(arm="arm", subject="id", primary=["score"], secondary=["marker"])).run()
    assert work.plan.outcome == "continuous" and work.plan.subgroups == ["centre"]
    assert work.incomplete == ["marker"] and "imputation" in work.tables  # older subjects miss it more often
    f = {r.finding: r for r in work.tables["findings"].collect()}
    a, b = (np.array([x[3] for x in rows if x[1] == g]) for g in "ab")
    va, vb = a.var(ddof=1), b.var(ddof=1)
    d = (a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * va + (len(b) - 1) * vb) / (len(a) + len(b) - 2))
    assert (f["score"].n, f["score"].n_a, f["score"].effect) == (240, 120, pytest.approx(d))
    assert f["score"].statistic == pytest.approx((a.mean() - b.mean()) / math.sqrt(va / len(a) + vb / len(b)))
    assert f["score"].significant and f["score"].category == "clinical_association" and f["score"].direction == "negative" and f["score"].n_80 == dist.t_test_size(d, 0.8)
    assert f["marker"].endpoint_type == "secondary" and f["marker"].correction == "Benjamini-Hochberg" and not f["marker"].gated_out and f["marker"].n == 240
    assert f["marker"].sentence == "Marker showed no significant association with marker."
    assert {r.term for r in work.tables["ancova"].collect()} == {"arm[a]", "arm[b]", "age"}
    assert {(r.subgroup, r.level) for r in work.tables["subgroups"].collect()} == {("centre", "x"), ("centre", "y")}


def test_three_arms(spark, tmp_path):
    df, rows = made(spark, 3)
    plan = analysis.Plan(arm="arm", subject="id", primary=["score"], outcome="continuous")
    tables = analysis.report(df.drop("marker"), plan, str(tmp_path / "report"))
    f = tables["findings"].collect()
    assert [(r.finding, r.test, r.n) for r in f] == [("score", "kruskal_wallis", 240)]
    assert {r.arm for r in tables["balance"].collect()} == {"b", "c"}
    assert {r.term for r in tables["ancova"].collect()} >= {"arm[a]", "arm[b]", "arm[c]"}
    assert sorted(p.name for p in (tmp_path / "report").iterdir()) == sorted(tables)
    assert spark.read.parquet(str(tmp_path / "report" / "findings")).count() == 1


def test_binary(spark):
    df, rows = made(spark)
    work = analysis.Analysis(df.drop("marker"), analysis.Plan(arm="arm", subject="id", primary=["cured"])).run()
    assert work.plan.outcome == "binary"
    a1, b1 = (sum(x[4] for x in rows if x[1] == g) for g in "ba")
    r = work.tables["findings"].first()
    assert r.effect == pytest.approx(a1 * (120 - b1) / (b1 * (120 - a1))) and r.n == 240 and r.effect_label == "odds_ratio" and r.direction == "negative" and r.significant
    c = analysis.Analysis(made(spark, 3)[0].drop("marker"), analysis.Plan(arm="arm", subject="id", primary=["cured"])).run().tables["findings"].first()
    assert (c.test, c.effect_label, c.n) == ("chi_square", "cramers_v", 240)


def test_survival_with_flags(spark):
    r = np.random.default_rng(4)
    rows = [(i, "abc"[i % 3], float(math.ceil(r.exponential(40))) if i % 17 else -1.0, int(r.random() < 0.5), i % 2, float(i % 5), 1) for i in range(300)]
    rows = [(*x[:5], x[5] + 2.0 * x[3], x[6]) for x in rows]
    df = spark.createDataFrame(rows, "id int, arm string, follow_up double, died int, smoker int, dose double, outcome int")
    work = analysis.Analysis(df, analysis.Plan(subject="id", arm="arm", time="follow_up", event="died")).run()
    f = {x.finding: x for x in work.tables["findings"].collect()}
    assert set(f) == {"survival_primary", "smoker", "dose"}  # outcome is named like one
    assert f["survival_primary"].n == sum(x[2] > 0 for x in rows) and f["survival_primary"].category == "statistical_note"
    assert f["smoker"].effect_label == "odds_ratio" and f["smoker"].n == 300
    k = [sum(x[4] == s and x[3] == e for x in rows) for s, e in ((1, 1), (1, 0), (0, 1), (0, 0))]
    assert f["smoker"].effect == pytest.approx(k[0] * k[3] / (k[1] * k[2])) and f["dose"].significant and f["dose"].direction == "positive"
    assert f["dose"].adjusted == pytest.approx(min(1, f["dose"].p * 3))
    assert {x.g for x in work.tables["survival"].collect()} == {"a", "b", "c"}


def test_longitudinal_and_what_is_missing(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(60):
        base = float(r.normal())
        rows += [(i, "ab"[i % 2], t, base + 0.5 * t * (i % 2) + float(r.normal()) * 0.3) for t in (0, 1, 2)]
    df = spark.createDataFrame(rows, "subject int, arm string, visit int, score double")
    plan = analysis.Plan(arm="arm", time="visit", subject="subject", primary=["score"], outcome="longitudinal")
    f = {x.test: x for x in analysis.Analysis(df, plan).run().tables["findings"].collect()}
    assert set(f) == {"mixed_model", "constrained_model"} and all(x.n == 180 and 0.6 < x.effect < 1.4 and x.significant for x in f.values())
    work = analysis.Analysis(df.select("score"), analysis.Plan(primary=["score"], outcome="continuous")).run()
    assert "findings" not in work.tables and {"balance", "tests", "ancova", "findings"} <= set(work.skipped)
    assert {x.state for x in work.summary().collect()} >= {"skipped", "derived"}
    with pytest.raises(ValueError):
        analysis.Analysis(df, analysis.Plan(outcome="other")).run()


@pytest.mark.parametrize("interaction", [False, True])
def test_covariance_of_arms(spark, interaction):
    df, rows = made(spark, 3)
    got = {r.term: r for r in models.ancova_arms(df, "score", "arm", ["age"], ["a", "b", "c"], interaction).collect()}
    age = np.array([x[2] for x in rows]) - np.mean([x[2] for x in rows])
    y, is_ = np.array([x[3] for x in rows]), [np.array([float(x[1] == g) for x in rows]) for g in "bc"]
    x = np.column_stack([np.ones(len(y)), *is_, age, *([i * age for i in is_] if interaction else [])])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    se = np.sqrt(np.diag(inverse @ (x.T * ((y - x @ beta) / (1 - h)) ** 2) @ x @ inverse))
    terms = ["arm[b]", "arm[c]", "age", *(["arm[b]:age", "arm[c]:age"] if interaction else [])]
    assert [got[t].coef for t in terms] == pytest.approx(list(beta[1:])) and [got[t].se for t in terms] == pytest.approx(list(se[1:]))
    assert [got[f"arm[{g}]"].mean for g in "abc"] == pytest.approx([beta[0], beta[0] + beta[1], beta[0] + beta[2]])


def test_levels_are_exact(spark):
    df = spark.range(5000).selectExpr("id % 6 AS six", "id % 7 AS seven", "CAST(id AS STRING) AS many", "CASE WHEN id % 2 = 0 THEN 1 END AS one", "CAST(NULL AS INT) AS none", "id % 2 AS `a.b`").repartition(9)
    assert levels(df) == {"six": (6, False), "seven": (7, False), "many": (7, False), "one": (1, True), "none": (0, False), "a.b": (2, True)}


def test_sample_sizes():
    # published values of two-sample and paired designs
    assert [dist.t_test_size(d, 0.8) for d in (0.2, 0.5, 0.8)] == [393, 64, 26] and [dist.t_test_size(d, 0.9) for d in (0.2, 0.5, 0.8)] == [526, 85, 34]
    assert [dist.t_test_size(d, 0.8, kind="paired") for d in (0.2, 0.5, 0.8)] == [198, 33, 14]
    assert dist.t_test_size(0.0, 0.8) is None and dist.t_test_size(None, 0.8) is None and dist.t_test_size(50.0, 0.8) == 2


def test_a_copy_of_a_column_missing_by_key_is_not_filled_in(spark):
    r = np.random.default_rng(7)
    y, age = np.round(r.uniform(0, 5000, 3000), 2), r.integers(20, 90, 3000)
    rows = [(i, i // 3 % 2, float(v), float(a), float(v) / 1000 if i % 3 == 0 else None) for i, (v, a) in enumerate(zip(y, age))]
    df = spark.createDataFrame(rows, "id int, arm int, cost double, age double, albumin double")
    plan = analysis.Plan(arm="arm", subject="id", primary=["cost"], secondary=["albumin"], outcome="continuous")
    work = analysis.Analysis(df, plan).run()
    assert work.tables["mcar"].first().p < 0.05 and "imputation" not in work.tables
    assert {f.finding: f.n for f in work.tables["findings"].collect()} == {"cost": 3000, "albumin": 1000}


def test_little_by_likelihood(spark):
    # one column misses values: the test is Hotelling's of the complete ones between rows that have it and rows that do not
    r = np.random.default_rng(3)
    a, b = r.normal(size=(2, 400))
    c = a + b + r.normal(size=400)
    seen = r.random(400) < 1 / (1 + np.exp(-0.4 * a))
    df = spark.createDataFrame([(float(x), float(y), float(w) if s else None, float(2 * x)) for x, y, w, s in zip(a, b, c, seen)], "a double, b double, c double, twice double")
    ab = np.stack([a, b])
    gap = [ab[:, k].mean(1) - ab.mean(1) for k in (seen, ~seen)]
    want = sum(k.sum() * g @ np.linalg.inv(np.cov(ab, ddof=0)) @ g for k, g in zip((seen, ~seen), gap))
    for columns in (["a", "b", "c"], ["a", "b", "c", "twice"]):
        got = models.little_likelihood(df, columns).first()
        assert (got.chi2, got.df, got.patterns) == (pytest.approx(want, rel=1e-6), 2, 2) and got.p == pytest.approx(dist.chi2_sf(want, 2), rel=1e-6)
