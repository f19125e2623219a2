"""Operators that SQL cannot express, or not cheaply, against dense versions and values in the literature."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.functions.columns import chi_square_sf, f_sf, two_sided_t
from cohortlake.operators import association, claims, comparison, evidence, findings, guardrails, longitudinal, profile, retrieval, roles, verification
from cohortlake.operators.longform import quantiles, ranks, value_counts
from cohortlake.sources import documents, tables


def test_tails_at_tabulated_values(spark):
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and dist.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and dist.f_sf(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    rows = spark.createDataFrame([(2.228139, 10.0), (None, 3.0), (1.0, 0.0)], "x double, df double")
    got = [tuple(r) for r in rows.select(two_sided_t("x", "df"), chi_square_sf("x", "df"), f_sf("x", "df", F.lit(5))).collect()]
    assert got[0] == pytest.approx((0.05, dist.chi2_sf(2.228139, 10), dist.f_sf(2.228139, 10, 5)), abs=1e-6) and got[1:] == [(None,) * 3] * 2


def test_quantiles_and_ranks(spark):
    r = np.random.default_rng(2)
    data = {"x": r.normal(size=500).round(2), "y": r.integers(0, 5, 77).astype(float), "z": np.array([3.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("n", None)], "g string, value double")
    shares = {"a": 0.0, "b": 0.13, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {q.g: q for q in quantiles(value_counts(rows, ["g"]), ["g"], shares).collect()}
    assert {*got} == {*data} and all(got[g][k] == pytest.approx(np.quantile(v, q)) for g, v in data.items() for k, q in shares.items())
    x = data["x"]
    own = {q.value: q["rank"] for q in ranks(rows.filter("g = 'x'"), "value").collect()}
    assert all(own[v] == (x < v).sum() + ((x == v).sum() + 1) / 2 for v in x)


def test_exact_mann_whitney():
    for na, nb in ((3, 4), (5, 5)):
        us = [sum(c) - na * (na + 1) / 2 for c in itertools.combinations(range(1, na + nb + 1), na)]
        for u in set(us):
            want = min(1.0, 2 * sum(x <= min(u, na * nb - u) for x in us) / len(us))
            assert association.exact_mann_whitney_p(u, na, nb) == pytest.approx(want)


def test_compare_groups_chooses(spark):
    few = spark.createDataFrame([("a", float(i**5)) for i in range(1, 8)] + [("b", float(i**5) + 0.5) for i in range(3, 10)] + [("c", 1.0), ("a", None)], "g string, v double")
    got = findings.compare_groups(few, "v", "g", "a", "b").first()
    assert got.test == "mann_whitney" and got.dropped == 1 and got.p == pytest.approx(association.exact_mann_whitney_p(got.statistic, 7, 7))
    with pytest.raises(ValueError):
        findings.compare_groups(few, "v", "g", "a", "c")


def dense_reml(x, y, s):
    def fit(r):
        v = np.eye(len(y)) + r * (s[:, None] == s[None, :])
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        beta = np.linalg.solve(a, x.T @ w @ y)
        e = y - x @ beta
        s2 = float(e @ w @ e) / (len(y) - x.shape[1])
        like = -0.5 * ((len(y) - x.shape[1]) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1])
        return like, beta, np.sqrt(np.diag(np.linalg.inv(a)) * s2), s2

    best = max(np.exp(np.linspace(-6, 3, 400)), key=lambda r: fit(r)[0])
    return best, *fit(best)


def test_mixed_models_against_dense_algebra(spark):
    r = np.random.default_rng(4)
    rows = [(i, t, i % 2, float(2 + t + (i % 2) * (t > 0) + b + r.normal())) for i in range(40) for b in [r.normal()] for t in range(r.integers(1, 4))]
    df = spark.createDataFrame([*rows, (99, 1, 0, None)], "s int, t int, a int, y double")
    s, t, a, y = (np.array(c) for c in zip(*rows))
    cols = [np.ones(len(y)), t == 1, t == 2, a == 1, (t == 1) & (a == 1), (t == 2) & (a == 1)]
    for out, keep in ((longitudinal.repeated_measures_model(df, "s", "t", "a", "y"), range(6)), (longitudinal.constrained_model(df, "s", "t", "a", "y"), (0, 1, 2, 4, 5))):
        ratio, like, beta, se, s2 = dense_reml(np.stack([cols[k] for k in keep], 1).astype(float), y, s)
        got = out.collect()
        assert [g.coef for g in got] == pytest.approx(beta, abs=2e-3) and [g.se for g in got] == pytest.approx(se, rel=2e-2)
        assert got[0].reml == pytest.approx(like, abs=1e-2) and got[0].between == pytest.approx(ratio * s2, rel=0.1) and got[0].rows == len(y) and got[0].subjects == 40


def test_imputation_restores_a_linear_relation(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=800)
    y = 3 * x + 5 + 0.1 * r.normal(size=800)
    df = spark.createDataFrame([(i, float(a), float(b) if i % 4 else None) for i, (a, b) in enumerate(zip(x, y))], "k int, x double, y double")
    filled = longitudinal.imputed(df, "k", ["y"], ["x"], copies=2, sweeps=2)
    assert filled.count() == 1600 and filled.filter("y IS NULL").count() == 0
    assert filled.filter("k % 4 = 0").agg(F.max(F.abs(F.col("y") - 3 * F.col("x") - 5))).first()[0] < 0.6
    got = longitudinal.pooled(filled, ["y"]).first()
    assert got["mean"] == pytest.approx(y.mean(), abs=0.02) and got.within == pytest.approx(y.var(ddof=1) / 800, rel=0.05) and got.total >= got.within
    assert sorted(map(tuple, longitudinal.completed(df, "k", ["y"], ["x"], 2).filter("k % 4 > 0").collect())) == sorted((i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y)) if i % 4)


def finding(key, variable, **more):
    base = dict(report=1, key=key, variable=variable, endpoint=None, claim_type=None, text="", significant=None, direction="unknown", p=None, effect=None, effect_label=None, ci_low=None, ci_high=None, test_family=None, rank=None)
    return {**base, **more}


KIND = "report int, key string, variable string, endpoint string, claim_type string, text string, significant boolean, direction string, p double, effect double, effect_label string, ci_low double, ci_high double, test_family string, rank int"


def test_pairing_takes_the_best_first(spark):
    left = [finding("a", "age", endpoint="mortality", text="age raises mortality"), finding("b", None, endpoint="survival", text="older patients die"), finding("c", "bmi", text="bmi")]
    right = [finding("x", "age", endpoint="survival", text="age raises mortality"), finding("y", "age", text="age"), finding("z", "sex", endpoint="mortality", text="older patients die")]
    pairs = comparison.candidates(*(spark.createDataFrame(s, KIND) for s in (left, right)))
    scores = {(p.l_key, p.r_key): p.score for p in pairs.collect()}
    assert scores == pytest.approx({("a", "x"): 0.95, ("a", "y"): 0.5 + 0.05 + 0.05, ("b", "x"): 0.3, ("b", "z"): 0.45})
    chosen = comparison.assigned(pairs)
    assert {(p.l_key, p.r_key) for p in chosen.collect()} == {("a", "x"), ("b", "z")}
    assert [u.key for u in comparison.unmatched(spark.createDataFrame(left, KIND), chosen, "l").collect()] == ["c"]


def test_effect_check(spark):
    rows = spark.createDataFrame([("odds_ratio", 2.0, 1.9, 1.2, 3.0), ("odds_ratio", 2.0, 0.8, 1.2, 3.0), ("odds_ratio", 3.0, 1.5, 1.2, 4.0), ("odds_ratio", 1.5, 1.6, 0.9, 2.0), ("cohen_d", 0.3, 0.9, None, None), ("cohen_d", None, 0.9, None, None)], "k string, a double, b double, lo double, hi double")
    assert [r.effect_verdict for r in comparison.effect_check(rows, "k", "a", "b", "lo", "hi").collect()] == ["verified", "contradicted", "partial", "partial", "partial", None]


def test_claims_as_they_are_written(spark):
    texts = [
        ("The new drug and clearance are associated: p = 0.004 in all sites.", ("=", 0.004, None, None, None, None, True, "binary_categorical_association")),
        ("Odds of relapse had an association with dose, OR 1.7 (95% CI: 1.1-2.6), p=0.02.", ("=", 0.02, "odds_ratio", 1.7, 1.1, 2.6, True, "binary_categorical_association")),
        ("Lactate predicts relapse: HR 0.61, 95% CI .44 to 0.87 and p < 0.001.", ("<", 0.001, "hazard_ratio", 0.61, 0.44, 0.87, True, None)),
        ("Weight differed by site (Cohen's d = -0.35).", (None, None, "cohens_d", -0.35, None, None, True, "continuous_group_difference")),
        ("By the log-rank test the wards differed, p=0.03.", ("=", 0.03, None, None, None, None, True, "kaplan_meier_logrank")),
        ("Dose and ward gave p = 0.05 and AUC of .71.", ("=", 0.05, "auc", 0.71, None, None, False, None)),
        ("Dose and ward gave p <= 0.05, SMD = -0.2, CI -0.4 to +0.1.", ("<=", 0.05, "smd", -0.2, -0.4, 0.1, True, None)),
        ("A mean difference of 3.5 and rho = -.2 were seen.", (None, None, "rho", -0.2, None, None, None, "continuous_group_difference")),
    ]
    rows = spark.createDataFrame([(t,) for t, _ in texts], "claim string")
    out = claims.interval(evidence.reported(rows, "claim"), "claim")
    got = out.select("p_operator", "p_value", "effect", "effect_value", "ci_low", "ci_high", claims.significant(F.col("claim"), F.col("p_operator"), F.col("p_value")), claims.family(F.col("claim"))).collect()
    assert [tuple(g) for g in got] == [w for _, w in texts]


def test_names_are_read_by_words(spark):
    assert [guardrails.rule_for(c, guardrails.RANGES) and guardrails.rule_for(c, guardrails.RANGES)[0] for c in ("stage_1", "triage_code", "dosage_mg", "salt_g", "age_years", "alk.phos", "ALT (U/L)")] == [None, None, None, None, "age", "alk_phos", "alt"]
    df = spark.createDataFrame([(1, 5.0, i % 2, i % 3, None) for i in range(9)], "trt_arm int, `follow-up days` double, death_event int, site int, gone string")
    assert roles.roles(df) == {"endpoint": "death_event", "arm": "site", "time": "follow-up days", "event": "death_event"}
    assert roles.kept_columns(df).columns == ["trt_arm", "follow-up days", "death_event", "site"] and "gone" in roles.kept_columns(df, ["gone"]).columns
    assert roles.protected(df, "Death Event", ["SITE"]) == ["death_event", "site"]


def test_variables_and_codes_of_claims(spark):
    df = spark.createDataFrame([(1.0, 2, 0), (2.0, 1, 1)], "serum_creatinine double, status int, event int")
    said = spark.createDataFrame([("Serum creatinine was higher.",), ("The status and event differ.",), ("Nothing here.",), ("statuses vary",)], "t string")
    assert [(r.variable, r.mentioned) for r in verification.resolved(said, "t", verification.aliases(df)).collect()] == [("serum_creatinine", 1), ("status", 2), (None, 0), (None, 0)]
    assert verification.event_codes(df, "event") == [1] and verification.event_codes(df, "status") is None and verification.event_codes(df, "status", meanings={"1": "transplant", "2": "death"}) == [2]


def test_sentence_chunks_and_rerank(spark):
    text = "One two three four. " * 30
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short"), (4, "x" * 900)], "k int, t string")
    got = [r for r in retrieval.sentence_chunks(docs, "k", "t", size=100, overlap=30, least=10).collect()]
    own = [r for r in got if r.k == 1]
    assert all(text[r.start : r.end] == r.text and r.end - r.start <= 100 for r in own) and own[-1].end == len(text) and all(b.start == a.end - 20 for a, b in zip(own, own[1:]))
    assert [r.end for r in got if r.k == 4] == [900] and not [r for r in got if r.k in (2, 3)]
    hits = spark.createDataFrame([(1, 1, 2.0, ["a", "b"], ["a"]), (1, 2, 1.99, ["a", "b"], ["a"]), (1, 3, 1.95, ["c"], ["a"])], "q int, d int, score double, words array<string>, asked array<string>")
    assert [(r.d, r.new_rank) for r in sorted(retrieval.rerank(hits, "q", "d", 3).collect(), key=lambda r: r.new_rank)] == [(1, 1), (3, 2), (2, 3)]


def test_tokens_of_queries(spark):
    row = spark.createDataFrame([("The Café's HR or p-value studies-based études, survived!",)], "t string")
    got = row.select(retrieval.tokens(F.col("t")).alias("a"), retrieval.query_tokens(F.col("t")).alias("b")).first()
    assert got.a == ["cafe'", "hr", "p-value", "studies-bas", "etud", "surviv"] and got.b[len(got.a) :] == ["hazard", "ratio", "odds", "ratio"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n2,\n")
    assert tables.load(spark, str(tmp_path / "a.csv")).dtypes == [("x", "int"), ("y", "string")] and tables.load(spark, str(tmp_path / "a.csv"), "x double, y string").dtypes[0][1] == "double"
    with pytest.raises(ValueError):
        tables.checked(tables.load(spark, str(tmp_path / "a.csv")).filter("x > 5"))
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "r.md").write_text("# Report\nAge mattered.")
    (tmp_path / "n" / "e.txt").write_text("  ")
    got = documents.reports(spark, str(tmp_path / "n")).collect()
    assert [(r.name, r.source_type, r.content) for r in got] == [("r.md", "file", "# Report\nAge mattered.")]
    tables.append(tables.logged(spark.createDataFrame([("t", "x" * 3000)], "tool string, out string"), "r1", "out"), str(tmp_path / "log"))
    assert [(r.tool, len(r.out), r.run_id) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("t", 2000, "r1")]


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None), (1.0, 5.0, None)], "one double, x double, gone double")
    assert [(r.a, r.b, r.r, r.p) for r in association.correlation_tests(df, ["one", "x", "gone"]).collect()] == [("one", "x", None, None), ("one", "gone", None, None), ("x", "gone", None, None)]
    s = {r.variable: r for r in profile.column_statistics(df, ["one", "x", "gone"]).collect()}
    assert (s["gone"].n, s["gone"].nulls, s["gone"]["mean"], s["gone"].p50) == (0, 3, None, None) and (s["one"].sd, s["one"].skewness, s["one"].distinct) == (0.0, None, 1)
    assert {r.variable: r.iqr for r in profile.outliers(df.union(df), ["one", "x", "gone"]).collect()} == {"one": 0, "x": 0}


def test_sizes_are_read_with_any_blanks(spark):
    texts = ["n  = 1200", "n=1,200", "a sample\tof 1200 women", "sample size of 1200", "we enrolled  1200", "participants: 1200", "participants = 1200", "seen = 1200", "nothing"]
    got = claims.evidence_strength(spark.createDataFrame([(t, 2020) for t in texts], "t string, y int"), "t", "y", 2024).collect()
    assert [g.sample_size for g in got] == [1200] * 7 + [None] * 2


def test_bullets_of_lines(spark):
    text = "- one two three four\n12) five six seven eight\n*bold* nine ten eleven\n•   a b c d\n3.5 mg were given daily\n-"
    got = claims.split_claims(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("line").collect()
    assert [g.claim for g in got] == ["one two three four", "five six seven eight", "*bold* nine ten eleven", "a b c d", "3.5 mg were given daily"]


def test_regressions_that_claims_name(spark):
    import numpy as np

    from cohortlake.operators import models, verification

    r = np.random.default_rng(6)
    rows = [(i, float(a := r.normal(50, 9)), int(r.random() < 1 / (1 + np.exp(-(a - 50) / 6))), float(np.ceil(r.exponential(40))), int(r.random() < 0.5), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, age double, died int, days double, smoker int, arm int")
    said = ["Age predicts death (p < 0.001).", "Higher age was a risk in those who died, hazard ratio 1.02 (p = 0.9).", "Smoker status was associated with death.", "Age was in balance at baseline (SMD 0.01).", "Arms differed in survival (p = 0.01).", "Nothing was said."]
    out = verification.verify(evidence.reported(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, claim string"), "claim"), "claim", df, event="died", arm="arm", time="days", known={"smoker": ["smoker status"]})
    got = {x.i: x for x in out.collect()}
    assert [got[i].family for i in range(6)] == ["logistic_regression", "cox_survival_predictor", "binary_categorical_association", "baseline_balance", "kaplan_meier_logrank", None]
    of = lambda t: t.filter("term = 'age'").first()
    assert got[0].p == pytest.approx(of(models.logistic(df, "died", ["age"])).p) and got[0].way == "positive" and got[0].verdict == "verified"
    fit = of(models.cox(df, "days", "died", ["age"]))
    assert got[1].p == pytest.approx(fit.p) and fit.low < fit.hazard_ratio < fit.high and 0 < fit.c_index < 1
    assert all(got[i].p is not None for i in range(5)) and got[5].p is None


def test_imputation_of_one_column_writes_nothing(spark):
    from pathlib import Path

    from cohortlake.operators.longform import shared_dir

    at = Path(shared_dir(spark).removeprefix("file:"))
    before = set(at.iterdir())
    df = spark.createDataFrame([(i, float(i % 9), float(i % 9) if i % 3 else None) for i in range(90)], "k int, x double, y double")
    assert longitudinal.imputed(df, "k", ["y"], ["x"]).count() == 450
    assert set(at.iterdir()) == before
