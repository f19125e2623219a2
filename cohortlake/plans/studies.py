"""Queries of inference, models, feature selection, guardrails and claims over the standard tables, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import claims, evidence, features, guardrails, inference, models
from cohortlake.plans.queries import MASKED, masked, query, rounded, subjects, table
from cohortlake.plans.tails import chi2_p, f_p, t_p, z_p


@query("kendall", "WITH c AS (SELECT l_quantity AS a, l_discount AS b, count(*) AS c FROM lineitem GROUP BY 1, 2), w AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM c), s AS (SELECT sum(CAST(x.c AS DOUBLE) * y.c * sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s FROM c x, c y), ta AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT CAST(sum(c) AS DOUBLE) AS k FROM c GROUP BY a)), tb AS (SELECT sum(k * (k - 1) / 2) AS t FROM (SELECT CAST(sum(c) AS DOUBLE) AS k FROM c GROUP BY b)) SELECT CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t)), 6) AS tau FROM w, s, ta, tb")
def kendall(spark, sf_dir):
    return rounded(inference.kendall(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"))


@query("fisher_exact", "WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels), k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM t), p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) AS p FROM k) SELECT a AS n11, b AS n10, c AS n01, d AS n00, round(least(a + b, c + d) * least(a + c, b + d) / (a + b + c + d), 6) AS min_expected, round(sum(p) FILTER (p <= (SELECT p FROM p WHERE k = a) * (1 + 1e-7)), 6) AS p FROM p GROUP BY a, b, c, d")
def fisher_exact(spark, sf_dir):
    return rounded(inference.fisher(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("normality_large", " UNION ALL ".join(f"""SELECT variable, n, round(zs, 4) AS z_skew, round(zk, 4) AS z_kurt, round(zs * zs + zk * zk, 4) AS k2, round(exp(-(zs * zs + zk * zk) / 2), 4) AS p FROM (SELECT '{c}' AS variable, n, zs, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM (
    SELECT *, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM (
    SELECT n, asinh(g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
        (b2 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * m * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
        6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS root FROM (
    SELECT *, sqrt(2 * (3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) - 1)) - 1 AS w2 FROM (
    SELECT count(*) AS n, CAST(count(*) AS DOUBLE) AS m, avg(pow(v - u, 3)) / pow(avg(pow(v - u, 2)), 1.5) AS g1, avg(pow(v - u, 4)) / pow(avg(pow(v - u, 2)), 2) AS b2 FROM (SELECT CAST({c} AS DOUBLE) AS v, avg({c}) OVER () AS u FROM orders))))))""" for c in ("o_totalprice", "o_custkey")))
def normality_large(spark, sf_dir):
    return rounded(inference.dagostino(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]), 4)


@query("normality_small")
def normality_small(spark, sf_dir):
    return rounded(inference.normality(table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query("bootstrap_difference")
def bootstrap_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("arm", F.col("c_nationkey") % 2)
    return rounded(inference.bootstrap_difference(rows, "c_custkey", "c_acctbal", "arm", 0, 1))


_SUB = """WITH s AS (SELECT '{c}' AS subgroup, {c} AS level, count(v) FILTER (g = 'F') AS n_a, count(v) FILTER (g = 'O') AS n_b, avg(v) FILTER (g = 'F') AS ma, avg(v) FILTER (g = 'O') AS mb, var_samp(v) FILTER (g = 'F') AS va, var_samp(v) FILTER (g = 'O') AS vb
    FROM (SELECT l_extendedprice AS v, l_linestatus AS g, CAST({c} AS VARCHAR) AS {c} FROM lineitem) GROUP BY {c}),
    x AS (SELECT *, (ma - mb) / sqrt(va / n_a + vb / n_b) AS t, pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df FROM s)
    SELECT subgroup, level, n_a, n_b, round(ma - mb, 4) AS diff, round(t, 4) AS t, round(df, 2) AS df, round({p}, 4) AS p, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 4) AS cohens_d, least(n_a, n_b) < 5 AS few FROM x"""


@query("subgroup_effects", " UNION ALL ".join(f"SELECT * FROM ({_SUB.format(c=c, p=t_p('t', 'df'))})" for c in ("l_returnflag", "l_linenumber")))
def subgroup_effects(spark, sf_dir):
    out = inference.subgroups(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", ["l_returnflag", "l_linenumber"], "F", "O")
    return rounded(out.withColumn("df", F.round("df", 2)), 4)


@query(
    "subgroup_odds",
    f"""WITH c AS (SELECT o_orderpriority AS level, CAST(count(*) FILTER (g AND y) AS DOUBLE) AS a1, CAST(count(*) FILTER (g AND NOT y) AS DOUBLE) AS a0, CAST(count(*) FILTER (NOT g AND y) AS DOUBLE) AS b1, CAST(count(*) FILTER (NOT g AND NOT y) AS DOUBLE) AS b0 FROM (SELECT o_orderpriority, o_custkey % 2 = 0 AS g, o_orderstatus = 'F' AS y FROM orders) GROUP BY 1),
    x AS (SELECT level, a1 + a0 AS na, b1 + b0 AS nb, a1, b1, CASE WHEN least(a1, a0, b1, b0) = 0 THEN 0.5 ELSE 0 END AS h, (a1 + a0 + b1 + b0) * pow(a1 * b0 - a0 * b1, 2) / ((a1 + a0) * (b1 + b0) * (a1 + b1) * (a0 + b0)) AS chi2, a0, b0 FROM c),
    o AS (SELECT *, (a1 + h) * (b0 + h) / ((a0 + h) * (b1 + h)) AS odds, sqrt(1 / (a1 + h) + 1 / (a0 + h) + 1 / (b1 + h) + 1 / (b0 + h)) AS se FROM x)
    SELECT 'o_orderpriority' AS subgroup, level, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(a1 / na, 6) AS rate_a, round(b1 / nb, 6) AS rate_b, round(chi2, 6) AS chi2, round({chi2_p("chi2", "1")}, 6) AS p, round(odds, 6) AS odds_ratio, round(exp(ln(odds) - 1.959963984540054 * se), 6) AS low, round(exp(ln(odds) + 1.959963984540054 * se), 6) AS high, least(na, nb) < 5 AS few FROM o""",
)
def subgroup_odds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "CAST(o_orderstatus = 'F' AS INT) AS y", "o_custkey % 2 AS arm")
    return rounded(inference.subgroup_odds(rows, "y", "arm", ["o_orderpriority"], 0, 1))


@query(
    "interaction_test",
    f"""WITH c AS (SELECT l_linestatus AS a, l_returnflag AS b, CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
    p AS (SELECT b, max(n) FILTER (a = 'F') AS n1, max(n) FILTER (a = 'O') AS n2, max(m) FILTER (a = 'F') AS m1, max(m) FILTER (a = 'O') AS m2 FROM c GROUP BY b),
    d AS (SELECT n1 * n2 / (n1 + n2) AS w, m1 - m2 AS d FROM p WHERE n1 IS NOT NULL AND n2 IS NOT NULL),
    s AS (SELECT sum(w * d * d) - pow(sum(w * d), 2) / sum(w) AS between, count(*) - 1 AS df1 FROM d),
    x AS (SELECT between / df1 / (within / df2) AS f, df1, CAST(df2 AS BIGINT) AS df2 FROM s, (SELECT sum(ss) AS within, sum(n) - count(*) AS df2 FROM c))
    SELECT round(f, 6) AS f, df1, df2, round({f_p("f", "df1", "df2")}, 6) AS p FROM x""",
)
def interaction_test(spark, sf_dir):
    return rounded(inference.interaction(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "l_returnflag"))


_SCREEN = """SELECT '{c}' AS variable, na AS n_a, nb AS n_b, round(t, 4) AS t, round({p}, 6) AS p, round(d, 6) AS cohens_d FROM (
    SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM (
    SELECT count({c}) FILTER (l_returnflag = 'R') AS na, count({c}) FILTER (l_returnflag <> 'R') AS nb, avg({c}) FILTER (l_returnflag = 'R') AS ma, avg({c}) FILTER (l_returnflag <> 'R') AS mb, var_samp({c}) FILTER (l_returnflag = 'R') AS va, var_samp({c}) FILTER (l_returnflag <> 'R') AS vb FROM lineitem))"""


@query("event_screening", " UNION ALL ".join(_SCREEN.format(c=c, p=t_p("t", "df")) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def event_screening(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("event", (F.col("l_returnflag") == "R").cast("int"))
    out = inference.screen(rows, "event", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(out.withColumn("t", F.round("t", 4)))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding a part brand: does the quantity ordered differ between line states?"""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_brand"), "l_partkey")
    return inference.subgroups(rows, "l_quantity", "l_linestatus", ["p_brand"], "F", "O")


@query("power_analysis")
def power_analysis(spark, sf_dir):
    return rounded(inference.power(findings(spark, sf_dir), "cohens_d", "n_a", "n_b").select("level", "n_a", "n_b", "cohens_d", "power", "power_class"))


@query(
    "logistic_regression",
    f"""WITH t AS (SELECT CAST(count(*) FILTER (y AND x = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT y AND x = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (y AND x = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT y AND x = 1) AS DOUBLE) AS d FROM (SELECT o_orderstatus = 'F' AS y, o_custkey % 2 AS x FROM orders)),
    l AS (SELECT *, a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) AS lk, (a + c) * ln((a + c) / (a + b + c + d)) + (b + d) * ln((b + d) / (a + b + c + d)) AS l0 FROM t),
    e AS (SELECT 'intercept' AS term, ln(a / b) AS coef, sqrt(1 / a + 1 / b) AS se, * FROM l UNION ALL SELECT 'x', ln(c * b / (a * d)), sqrt(1 / a + 1 / b + 1 / c + 1 / d), * FROM l)
    SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(exp(coef), 6) AS odds_ratio, round(coef / se, 6) AS z, round({z_p("(coef / se)")}, 6) AS p, round(exp(coef - 1.959963984540054 * se), 6) AS low, round(exp(coef + 1.959963984540054 * se), 6) AS high, CAST(a + b + c + d AS BIGINT) AS n, round(1 - lk / l0, 6) AS mcfadden_r2, round(4 - 2 * lk, 4) AS aic, round(2 * ln(a + b + c + d) - 2 * lk, 4) AS bic FROM e""",
)
def logistic_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderstatus = 'F' AS INT) AS y", "o_custkey % 2 AS x")
    out = models.logistic(rows, "y", ["x"]).select("term", "coef", "se", "odds_ratio", "z", "p", "low", "high", "n", "mcfadden_r2", F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"))
    return rounded(out)


@query("cox_regression")
def cox_regression(spark, sf_dir):
    return rounded(models.cox(subjects(spark, sf_dir), "time", "event", ["arm"]))


@query("ancova", "WITH m AS (SELECT CAST(l_linestatus = 'O' AS INT) AS t, l_quantity AS q, l_extendedprice AS y FROM lineitem), s AS (SELECT covar_pop(t, y) AS ty, covar_pop(q, y) AS qy, covar_pop(t, q) AS tq, var_pop(t) AS tt, var_pop(q) AS qq, avg(y) AS my, avg(t) AS mt, count(*) AS n FROM m), b AS (SELECT *, (ty * qq - qy * tq) / (tt * qq - tq * tq) AS coef FROM s) SELECT round(coef, 4) AS coef, round(my - coef * mt, 4) AS mean_a, round(my - coef * mt + coef, 4) AS mean_b, n FROM b")
def ancova(spark, sf_dir):
    return rounded(models.ancova(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", ["l_quantity"], "F", "O").select("coef", "mean_a", "mean_b", "n"), 4)


@query("mcar_test", f"WITH m AS (SELECT a, b FROM {MASKED}), w AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) FILTER (b IS NOT NULL) AS va2, covar_samp(a, b) AS ab, var_samp(a) AS va, var_samp(b) AS vb FROM m), g AS (SELECT a IS NOT NULL AS ha, b IS NOT NULL AS hb, count(*) AS n, avg(a) AS pa, avg(b) AS pb FROM m GROUP BY 1, 2), d AS (SELECT ha, hb, n, pa - ma AS da, pb - mb AS db, va, vb, ab FROM g, w), y AS (SELECT sum(CASE WHEN ha AND hb THEN n * (da * da * vb - 2 * da * db * ab + db * db * va) / (va * vb - ab * ab) WHEN ha THEN n * da * da / va WHEN hb THEN n * db * db / vb ELSE 0 END) AS chi2, CAST(sum(CAST(ha AS INT) + CAST(hb AS INT)) - max(CAST(NOT ha AS INT)) - max(CAST(NOT hb AS INT)) AS BIGINT) AS df, count(*) AS patterns FROM d) SELECT round(chi2, 4) AS chi2, df, round({chi2_p('chi2', 'df')}, 4) AS p, patterns FROM y")
def mcar_test(spark, sf_dir):
    return rounded(models.little(masked(spark, sf_dir), ["a", "b"]), 4)


_F = "SELECT '{c}' AS variable, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) AS f, count(*) AS classes, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count({c}) AS n, CAST(sum({c}) AS DOUBLE) AS s, var_pop({c}) * count({c}) AS w FROM events GROUP BY 1)"


@query("univariate_selection", "WITH f AS (" + " UNION ALL ".join(_F.format(c=c) for c in ("value", "user_id", "event_id")) + ") SELECT variable, round(f, 4) AS f, round(" + f_p("f", "(classes - 1)", "(n - classes)") + ", 4) AS p, round(f / max(f) OVER (), 4) AS score FROM f")
def univariate_selection(spark, sf_dir):
    return rounded(features.univariate(table(spark, sf_dir, "events"), "event_type", ["value", "user_id", "event_id"]), 4)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query("redundancy", "SELECT count(*) AS pairs, round(avg(abs(r)), 6) AS mean_abs_r FROM (" + " UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ")")
def redundancy(spark, sf_dir):
    return rounded(features.redundancy(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query("mrmr_selection")
def mrmr_selection(spark, sf_dir):
    return rounded(features.mrmr(table(spark, sf_dir, "lineitem"), "l_returnflag", _NUMBERS))


@query("lasso_selection")
def lasso_selection(spark, sf_dir):
    return rounded(features.elastic_net(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"]))


@query("diverse_selection")
def diverse_selection(spark, sf_dir):
    return features.diverse(table(spark, sf_dir, "lineitem"), "l_returnflag", _NUMBERS, must=["l_tax"], size=4)


_PATIENTS = "c_custkey AS patient, 20 + c_custkey % 120 AS age, c_acctbal / 90 AS serum_bili, c_acctbal / 500 AS albumin, c_nationkey % 3 AS arm, c_mktsegment AS segment, CAST(c_acctbal AS {s}) AS balance, concat('2024-0', CAST(1 + c_custkey % 9 AS {s}), '-11') AS seen"


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under clinical names."""
    return table(spark, sf_dir, "customer").selectExpr(*(c.strip() for c in ["c_custkey AS patient", "20 + c_custkey % 120 AS age", "c_acctbal / 90 AS serum_bili", "c_acctbal / 500 AS albumin", "c_nationkey % 3 AS arm", "c_mktsegment AS segment", "CAST(c_acctbal AS STRING) AS balance", "concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-11') AS seen"]))


_P = f"(SELECT {_PATIENTS.format(s='VARCHAR')} FROM customer)"


@query("range_violations", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, '{u}' AS unit, count({c}) AS n, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS outside, round(100.0 * count(*) FILTER ({c} < {lo} OR {c} > {hi}) / count({c}), 1) AS percent, CASE WHEN round(100.0 * count(*) FILTER ({c} < {lo} OR {c} > {hi}) / count({c}), 1) > 10 THEN 'high' WHEN round(100.0 * count(*) FILTER ({c} < {lo} OR {c} > {hi}) / count({c}), 1) > 2 THEN 'medium' ELSE 'low' END AS severity FROM {_P}" for c, lo, hi, u in (("age", 0, 130, "years"), ("serum_bili", 0, 100, "mg/dL"), ("albumin", 0.5, 8, "g/dL"))) + ") WHERE outside > 0")
def range_violations(spark, sf_dir):
    return rounded(guardrails.range_violations(patients(spark, sf_dir)))


@query("unit_plausibility", "SELECT variable, low, high, round(median, 4) AS median FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, quantile_cont({c}, 0.5) AS median FROM {_P}" for c, lo, hi in (("age", 1, 100), ("serum_bili", 0, 50), ("albumin", 1, 6))) + ") WHERE median < low OR median > high")
def unit_plausibility(spark, sf_dir):
    return rounded(guardrails.implausible_units(patients(spark, sf_dir)), 4)


@query("low_cardinality_numeric", f"SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS levels FROM {_P} HAVING bool_and({c} = floor({c})) AND count(DISTINCT {c}) BETWEEN 2 AND 6" for c in ("age", "serum_bili", "albumin", "arm")) + ")")
def low_cardinality_numeric(spark, sf_dir):
    return rounded(guardrails.low_cardinality(patients(spark, sf_dir), ["patient"]))


@query("repeated_measures", "SELECT count(*) AS subjects, count(*) FILTER (c > 1) AS repeating, max(c) AS most, max(c) >= 3 OR count(*) FILTER (c > 1) > 0.5 * count(*) AS longitudinal FROM (SELECT count(*) AS c FROM events GROUP BY user_id)")
def repeated_measures(spark, sf_dir):
    return rounded(guardrails.repeated_measures(table(spark, sf_dir, "events"), "user_id"))


@query("treatment_columns", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS levels, round(max(c) FILTER ({c} IS NOT NULL) / sum(c), 6) AS top_share FROM (SELECT {c}, count(*) AS c FROM (SELECT c_nationkey % 3 AS arm, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 2 END AS trt_arm, c_nationkey AS treatment_site FROM customer) GROUP BY 1)" for c in ("arm", "trt_arm", "treatment_site")) + ") WHERE levels BETWEEN 2 AND 5 AND top_share <= 0.6")
def treatment_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey % 3 AS arm", "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 2 END AS trt_arm", "c_nationkey AS treatment_site", "c_custkey % 2 AS grouped", "c_custkey % 3 AS stage")
    return rounded(guardrails.treatment_columns(rows))


@query("dataset_overview", f"SELECT count(*) AS n_rows, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) AS complete, (SELECT count(*) FROM (SELECT unnest(['l_orderkey', 'l_returnflag', 'a', 'b', 'c']))) AS n_columns, (SELECT count(*) FROM (SELECT DISTINCT unnest([typeof(l_orderkey) || 1, typeof(a) || 2, typeof(b) || 3, typeof(c) || 4]) FROM {MASKED} WHERE a IS NOT NULL)) AS n_numeric FROM {MASKED}")
def dataset_overview(spark, sf_dir):
    return rounded(guardrails.overview(masked(spark, sf_dir)))


_COERCE = "(SELECT CAST(c_acctbal AS VARCHAR) AS balance, '2024-0' || CAST(1 + c_custkey % 9 AS VARCHAR) || '-11' AS seen, CASE WHEN c_custkey % 10 = 0 THEN '2024-1-5 note' ELSE '2024-01-05' END AS noted, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE '1' END AS mixed, CAST(c_custkey % 2 AS DOUBLE) AS flag, CAST(c_custkey AS DOUBLE) AS whole, c_nationkey % 4 AS site FROM customer)"
_DAY = "try_strptime({c}, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d']) IS NOT NULL AND length({c}) = 10"


@query(
    "type_coercion",
    "SELECT variable, suggestion, round(rate, 6) AS rate FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS variable, CASE WHEN x > 0.9 THEN 'numeric' WHEN y > 0.8 THEN 'date' END AS suggestion, CASE WHEN x > 0.9 THEN x ELSE y END AS rate FROM (SELECT avg(CAST(try_cast({c} AS DOUBLE) IS NOT NULL AS INT)) AS x, avg(CAST({_DAY.format(c=c)} AS INT)) AS y FROM {_COERCE})" for c in ("balance", "seen", "noted", "mixed"))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', CASE WHEN {fl} AND bool_and({c} IN (0, 1)) THEN 'boolean' WHEN {fl} AND bool_and({c} = floor({c})) AND count(DISTINCT {c}) > greatest(0.8 * count({c}), 50) THEN 'whole' WHEN NOT {fl} AND count(DISTINCT {c}) <= 8 AND count(DISTINCT {c}) < greatest(0.05 * count({c}), 3) THEN 'category' END, count(DISTINCT {c}) / count({c}) FROM {_COERCE}" for c, fl in (("flag", "true"), ("whole", "true"), ("site", "false")))
    + ") WHERE suggestion IS NOT NULL",
)
def type_coercion(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("CAST(c_acctbal AS STRING) AS balance", "concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-11') AS seen", "CASE WHEN c_custkey % 10 = 0 THEN '2024-1-5 note' ELSE '2024-01-05' END AS noted", "CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE '1' END AS mixed", "CAST(c_custkey % 2 AS DOUBLE) AS flag", "CAST(c_custkey AS DOUBLE) AS whole", "c_nationkey % 4 AS site")
    return rounded(guardrails.coercions(rows))


@query("guardrail_summary", f"WITH p AS (SELECT * FROM {_P}), r AS (SELECT CASE WHEN x > 10 THEN 'high' WHEN x > 2 THEN 'medium' ELSE 'low' END AS severity FROM (" + " UNION ALL ".join(f"SELECT round(100.0 * count(*) FILTER ({c} < {lo} OR {c} > {hi}) / count({c}), 1) AS x, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS k FROM p" for c, lo, hi in (("age", 0, 130), ("serum_bili", 0, 100), ("albumin", 0.5, 8))) + ") WHERE k > 0), f AS (SELECT 'range_violation' AS check_type, severity FROM r UNION ALL SELECT 'unit_plausibility', 'medium' FROM (" + " UNION ALL ".join(f"SELECT quantile_cont({c}, 0.5) NOT BETWEEN {lo} AND {hi} AS bad FROM p" for c, lo, hi in (("age", 1, 100), ("serum_bili", 0, 50), ("albumin", 1, 6))) + ") WHERE bad UNION ALL SELECT 'low_cardinality_numeric', 'low' FROM (SELECT count(DISTINCT arm) AS k FROM p) WHERE k BETWEEN 2 AND 6 UNION ALL SELECT 'repeated_measures', CASE WHEN max(c) >= 3 OR count(*) FILTER (c > 1) > 0.5 * count(*) THEN 'medium' ELSE 'low' END FROM (SELECT count(*) AS c FROM p GROUP BY patient) HAVING max(c) > 1) SELECT check_type, severity, count(*) AS n FROM f GROUP BY 1, 2")
def guardrail_summary(spark, sf_dir):
    return rounded(guardrails.finding_summary(patients(spark, sf_dir), "patient"))


@query("label_encoding", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_code FROM customer")
def label_encoding(spark, sf_dir):
    return rounded(guardrails.label_encode(table(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "c_mktsegment_code"))


@query("dummy_encoding", "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS BIGINT) AS \"o_orderstatus_P\" FROM orders")
def dummy_encoding(spark, sf_dir):
    out = guardrails.dummies(table(spark, sf_dir, "orders"), "o_orderstatus")
    return rounded(out.select("o_orderkey", *(c for c in out.columns if c.startswith("o_orderstatus_"))))


@query("stratified_sample", "WITH q AS (SELECT o_orderstatus, greatest(1, CAST(round(500 * count(*) / (SELECT count(*) FROM orders)) AS INT)) AS q FROM orders GROUP BY 1), r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) SELECT o_orderkey, o_orderstatus FROM r JOIN q USING (o_orderstatus) WHERE r <= q")
def stratified_sample(spark, sf_dir):
    return guardrails.stratified_sample(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 500).select("o_orderkey", "o_orderstatus")


@query("sample_rows", "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS matching FROM orders WHERE o_orderstatus = 'P' ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 20")
def sample_rows(spark, sf_dir):
    out = guardrails.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", column="o_orderstatus", equal="P")
    return out.drop("o_orderstatus")


@query("prepared_columns", "WITH m AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END AS bal FROM customer) SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM m)), 6) AS bal FROM m")
def prepared_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", "CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END AS bal")
    return rounded(guardrails.prepared(rows, ["c_mktsegment", "bal"]))


@query("boxplot", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), r AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events JOIN q USING (event_type)) SELECT event_type, count(*) AS n, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, round(min(value) FILTER (inside), 4) AS low, round(max(value) FILTER (inside), 4) AS high, count(*) FILTER (NOT inside) AS beyond FROM r GROUP BY event_type, q1, m, q3")
def boxplot(spark, sf_dir):
    return rounded(guardrails.boxplot(table(spark, sf_dir, "events"), "value", "event_type"), 4)


@query("density", "WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, count(*) AS n, stddev_samp(p_size) * pow(count(*), -0.2) AS h FROM part), c AS (SELECT p_size AS v, count(*) AS c FROM part GROUP BY 1), g AS (SELECT *, unnest(range(0, 100)) AS point FROM s), x AS (SELECT *, a + (b - a) * point / 99 AS x FROM g) SELECT point, round(x, 6) AS x, round(sum(c * exp(-pow((x - v) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM x, c GROUP BY point, x")
def density(spark, sf_dir):
    return rounded(guardrails.density(table(spark, sf_dir, "part"), "p_size"))


@query("claim_candidates", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents), b AS (SELECT doc_id, line, trim(regexp_replace(l, '^\s*([-*•]|\d+[.)])\s+', ''), ' ') AS l FROM l), p AS (SELECT doc_id, line, CASE WHEN length(l) >= 180 THEN string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE [l] END AS ps FROM b), e AS (SELECT doc_id, line, unnest(range(0, len(ps))) AS part, trim(unnest(ps), ' ') AS claim FROM p) SELECT * FROM e WHERE len(regexp_split_to_array(claim, '\s+')) >= 4")
def claim_candidates(spark, sf_dir):
    return rounded(claims.split_claims(table(spark, sf_dir, "documents"), "doc_id", "text"))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim a supplier, written from its lines: every third overstates."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("d"))
    p = F.round((F.col("l_suppkey") * 7 % 100) / 1000.0 + F.col("d"), 3)
    s = s.withColumn("p", p).withColumn("way", F.when(F.col("n") % 2 == 0, "positive").otherwise("negative"))
    said = F.when(F.col("l_suppkey") % 3 == 0, F.format_string("Quantity was significantly higher for supplier %s (p=0.010).", "l_suppkey")).otherwise(F.format_string("Quantity %s, %s (OR = 1.50, 95%% CI 1.80 to 1.20, p=%s).", F.when(F.col("p") < 0.05, F.concat(F.lit("was associated with "), F.when(F.col("way") == "positive", "higher").otherwise("lower"), F.lit(" demand"))).otherwise("showed no association"), "l_suppkey", F.col("p").cast("string")))
    return s.withColumn("claim", said)


@query("claim_extraction", "WITH s AS (SELECT l_suppkey, count(*) AS n, round((l_suppkey * 7 % 100) / 1000.0 + min(l_discount), 3) AS p FROM lineitem GROUP BY 1) SELECT l_suppkey, '=' AS p_operator, CASE WHEN l_suppkey % 3 = 0 THEN 0.01 ELSE p END AS p_value, CASE WHEN l_suppkey % 3 <> 0 THEN 'odds_ratio' END AS effect, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(1.5 AS DOUBLE) END AS effect_value, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(1.2 AS DOUBLE) END AS ci_low, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(1.8 AS DOUBLE) END AS ci_high, CASE WHEN l_suppkey % 3 = 0 THEN true ELSE p < 0.05 END AS significant, CASE WHEN l_suppkey % 3 = 0 THEN 'continuous_group_difference' ELSE 'binary_categorical_association' END AS family, CASE WHEN l_suppkey % 3 = 0 THEN 'positive' WHEN p < 0.05 THEN CASE WHEN n % 2 = 0 THEN 'positive' ELSE 'negative' END END AS direction FROM s")
def claim_extraction(spark, sf_dir):
    out = claims.interval(evidence.reported(written(spark, sf_dir), "claim"), "claim")
    sig = claims.significant(F.col("claim"), F.col("p_operator"), F.col("p_value"))
    return rounded(out.select("l_suppkey", "p_operator", "p_value", "effect", "effect_value", "ci_low", "ci_high", sig.alias("significant"), claims.family(F.col("claim")).alias("family"), claims.direction(F.col("claim")).alias("direction")))


@query("claim_verdicts", "WITH s AS (SELECT l_suppkey, count(*) AS n, round((l_suppkey * 7 % 100) / 1000.0 + min(l_discount), 3) AS p FROM lineitem GROUP BY 1), v AS (SELECT CASE WHEN l_suppkey % 3 <> 0 THEN 'verified' WHEN p >= 0.05 THEN 'contradicted' WHEN n % 2 = 1 THEN 'contradicted' WHEN abs(p - 0.01) <= 0.0025 THEN 'verified' ELSE 'partial' END AS v FROM s) SELECT count(*) AS claims, count(*) FILTER (v = 'verified') AS verified, count(*) FILTER (v = 'contradicted') AS contradicted, count(*) FILTER (v = 'partial') AS partial, 0 AS unsupported, 0 AS not_verifiable, round(count(*) FILTER (v = 'verified') / count(*), 6) AS verified_rate FROM v")
def claim_verdicts(spark, sf_dir):
    out = evidence.reported(written(spark, sf_dir), "claim")
    out = out.withColumn("significant", claims.significant(F.col("claim"), F.col("p_operator"), F.col("p_value")))
    return rounded(claims.verdict_counts(claims.verdict(out, "claim", "p", "way")))


@query("finding_pairs")
def finding_pairs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("words", F.concat_ws(" ", "p_name", "p_type"))
    left, right = parts.filter("p_partkey % 2 = 0"), parts.filter("p_partkey % 2 = 1")
    left, right = (d.withColumn("topic", F.concat_ws("/", "p_brand", "p_size")) for d in (left, right))
    return claims.pair(left.withColumnRenamed("p_partkey", "finding"), "finding", "words", right.withColumnRenamed("p_partkey", "claim"), "claim", "words", "topic")


_KIND = "CASE " + " ".join("WHEN regexp_matches(lower(text), '{}') THEN {{}}".format(rule) for _, _, rule in claims.STUDIES) + " ELSE {} END"


@query("evidence_strength", rf"WITH a AS (SELECT doc_id, 2000 + doc_id % 25 AS year, {_KIND.format(*(repr(n) for n, _, _ in claims.STUDIES), repr('unknown'))} AS study_type, {_KIND.format(*(p for _, p, _ in claims.STUDIES), 8)} AS points, TRY_CAST(replace(regexp_extract(lower(text), '{claims.SAMPLE_SIZE}', 1), ',', '') AS BIGINT) AS sample_size FROM documents), s AS (SELECT *, CASE WHEN 2026 - year <= 2 THEN 40 WHEN 2026 - year <= 5 THEN 30 WHEN 2026 - year <= 10 THEN 20 WHEN 2026 - year <= 20 THEN 10 ELSE 0 END + points + CASE WHEN sample_size IS NULL THEN 5 WHEN sample_size >= 10000 THEN 20 WHEN sample_size >= 1000 THEN 15 WHEN sample_size >= 100 THEN 10 WHEN sample_size >= 20 THEN 5 ELSE 0 END AS strength FROM a) SELECT doc_id, study_type, sample_size, strength, CASE WHEN strength >= 70 THEN 'Strong' WHEN strength >= 45 THEN 'Moderate' WHEN strength >= 20 THEN 'Weak' ELSE 'Insufficient' END AS strength_label FROM s")
def evidence_strength(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("year", 2000 + F.col("doc_id") % 25)
    return rounded(claims.evidence_strength(docs, "text", "year", 2026).select("doc_id", "study_type", "sample_size", "strength", "strength_label"))


@query("scatter", "SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS x, round(p_retailprice, 4) AS y FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 500")
def scatter(spark, sf_dir):
    return rounded(guardrails.scatter(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice"), 4)


@query("grouped_histogram", 'WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT event_type AS "group", least(CAST(floor((value - a) / ((b - a) / 20)) AS BIGINT) + 1, 20) AS bin, round(a + (least(CAST(floor((value - a) / ((b - a) / 20)) AS BIGINT) + 1, 20) - 1) * (b - a) / 20, 4) AS low, count(*) AS count FROM events, e GROUP BY ALL')
def grouped_histogram(spark, sf_dir):
    return rounded(guardrails.grouped_histogram(table(spark, sf_dir, "events"), "value", "event_type"), 4)
