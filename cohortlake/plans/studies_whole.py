"""The whole analysis of a trial table and its report, stage by stage, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import analysis
from cohortlake.plans.queries import query, rounded, rounded_as_sql, table
from cohortlake.plans.tails import chi2_p, t_p
from cohortlake.plans.trials import TRIAL, trial

NUMBERS = ["cost", "age", "albumin"]
PLAN = analysis.Plan(subject="subject")


def analysed(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    return analysis.Analysis(trial(spark, sf_dir), PLAN).run()


_DIGITS = """SELECT 1 AS stage, 'digit_preference' AS step, '{c}' AS variable, CAST(sum(c) AS BIGINT) AS n, 10.0 * sum(c * c) / sum(c) - sum(c) AS statistic, 9 AS df
FROM (SELECT CAST(round_even(abs({c}), 0) AS BIGINT) % 10 AS d, count(*) AS c FROM s WHERE {c} IS NOT NULL GROUP BY 1)"""
_BALANCE = """SELECT 'balance' AS step, '{c}' AS variable, count({c}) AS n,
    (avg({c}) FILTER (trt_arm = 0) - avg({c}) FILTER (trt_arm = 1)) / sqrt((var_samp({c}) FILTER (trt_arm = 0) + var_samp({c}) FILTER (trt_arm = 1)) / 2) AS statistic FROM s"""


@query(
    "trial_integrity",
    f"""
WITH s AS (SELECT * FROM {TRIAL}),
d AS ({" UNION ALL ".join(_DIGITS.format(c=c) for c in NUMBERS)}),
b AS ({" UNION ALL ".join(_BALANCE.format(c=c) for c in NUMBERS)}),
w AS (SELECT avg(albumin) AS ma, avg(age) AS mg, avg(cost) AS mc, covar_samp(age, age) AS gg, covar_samp(age, cost) AS gc, covar_samp(cost, cost) AS cc FROM s),
g AS (SELECT count(*) AS n, avg(age) - (SELECT mg FROM w) AS dg, avg(cost) - (SELECT mc FROM w) AS dc, avg(albumin) - (SELECT ma FROM w) AS da, albumin IS NOT NULL AS has FROM s GROUP BY albumin IS NOT NULL),
m3 AS (SELECT var_samp(albumin) AS aa, covar_samp(albumin, age) AS ag, covar_samp(albumin, cost) AS ac FROM s),
-- patterns without albumin: a quadratic form in two differences; those with it: in three, by cofactors
q AS (
    SELECT sum(CASE WHEN has THEN n * (
            da * da * (gg * cc - gc * gc) + dg * dg * (aa * cc - ac * ac) + dc * dc * (aa * gg - ag * ag)
            + 2 * da * dg * (ac * gc - ag * cc) + 2 * da * dc * (ag * gc - ac * gg) + 2 * dg * dc * (ag * ac - aa * gc))
            / (aa * (gg * cc - gc * gc) - ag * (ag * cc - ac * gc) + ac * (ag * gc - ac * gg))
        ELSE n * (dg * dg * cc - 2 * dg * dc * gc + dc * dc * gg) / (gg * cc - gc * gc) END) AS chi2,
        CAST(sum(CASE WHEN has THEN 3 ELSE 2 END) - 3 AS BIGINT) AS df FROM g, w, m3)
SELECT step, variable, n, round(statistic, 4) AS statistic, round({chi2_p("statistic", "df")}, 4) AS p, {chi2_p("statistic", "df")} < 0.05 AS concern FROM d
UNION ALL SELECT step, variable, n, round(statistic, 4), NULL, abs(statistic) > 0.1 FROM b
UNION ALL SELECT 'mcar', 'albumin', (SELECT count(*) FROM s), round(chi2, 4), round({chi2_p("chi2", "df")}, 4), {chi2_p("chi2", "df")} < 0.05 FROM q""",
)
def trial_integrity(spark, sf_dir):
    """Stage 1: digits, balance of the arms, and whether values are missing completely at random."""
    rows = trial(spark, sf_dir)
    work = analysis.Analysis(rows, PLAN)
    work.integrity()
    t = work.tables
    none = F.lit(None).cast("double")
    digits = t["digit_preference"].select(F.lit("digit_preference").alias("step"), "variable", "n", F.col("chi2").alias("statistic"), "p", F.col("flagged").alias("concern"))
    balance = t["balance"].select(F.lit("balance"), "variable", F.col("n_a") + F.col("n_b"), "smd", none, "flagged")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    mcar = t["mcar"].crossJoin(n).select(F.lit("mcar"), F.lit(",".join(work.incomplete)), "n", "chi2", "p", F.col("p") < 0.05)  # one row each
    return rounded(digits.union(balance).union(mcar), 4)


_TEST = """SELECT '{c}' AS finding, 'welch' AS test, na + nb AS n, na AS n_a, nb AS n_b, 'cohen_d' AS effect_label, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS effect,
    (ma - mb) / sqrt(va / na + vb / nb) AS statistic, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df
FROM (SELECT count({c}) FILTER (death_event = 1) AS na, count({c}) FILTER (death_event = 0) AS nb, avg({c}) FILTER (death_event = 1) AS ma, avg({c}) FILTER (death_event = 0) AS mb,
    var_samp({c}) FILTER (death_event = 1) AS va, var_samp({c}) FILTER (death_event = 0) AS vb FROM s)"""


@query(
    "trial_analysis",
    f"""
WITH s AS (SELECT * FROM {TRIAL}),
v AS (SELECT trt_arm AS g, follow_up_days AS t, death_event AS e FROM s WHERE follow_up_days > 0),
tt AS (SELECT DISTINCT t FROM v WHERE e = 1),
x AS (
    SELECT tt.t, count(*) FILTER (v.t >= tt.t AND g = 0) AS n0, count(*) FILTER (v.t >= tt.t AND g = 1) AS n1,
        count(*) FILTER (v.t = tt.t AND e = 1 AND g = 0) AS d0, count(*) FILTER (v.t = tt.t AND e = 1 AND g = 1) AS d1 FROM tt, v GROUP BY 1),
z AS (
    SELECT sum(d0) - sum((d0 + d1) * n0 / (n0 + n1)) AS u,
        sum(CASE WHEN n0 + n1 > 1 THEN (d0 + d1) * (n0 / (n0 + n1)) * (n1 / (n0 + n1)) * (n0 + n1 - d0 - d1) / (n0 + n1 - 1) ELSE 0 END) AS var FROM x),
l AS (SELECT u * u / var AS chi2 FROM z),
f AS ({" UNION ALL ".join(_TEST.format(c=c) for c in NUMBERS)}),
p AS (
    SELECT finding, test, n, n_a, n_b, effect_label, effect, statistic, {t_p("statistic", "df")} AS p FROM f
    UNION ALL SELECT 'survival_primary', 'log_rank', (SELECT count(*) FROM v), NULL, NULL, 'logrank', NULL, chi2, {chi2_p("chi2", "1")} FROM l),
a AS (SELECT *, least(p * count(*) OVER (), 1) AS adjusted FROM p),
y AS (
    SELECT *, adjusted < 0.05 AS significant, CASE WHEN effect_label = 'logrank' THEN 'unknown' WHEN effect > 0 THEN 'positive' WHEN effect < 0 THEN 'negative' ELSE 'none' END AS direction,
        CASE WHEN finding = 'survival_primary' THEN 'statistical_note' WHEN adjusted < 0.05 THEN 'clinical_association' ELSE 'negative_association' END AS category FROM a)
SELECT finding, 'death_event' AS endpoint, 'primary' AS endpoint_type, test, n, n_a, n_b, effect_label, round(effect, 4) AS effect, round(statistic, 4) AS statistic, round(p, 4) AS p, round(adjusted, 4) AS adjusted,
    'Bonferroni' AS correction, false AS gated_out, significant, category, direction,
    CASE WHEN category = 'statistical_note' THEN NULL
         WHEN significant THEN 'Higher ' || finding || ' was associated with ' || CASE direction WHEN 'positive' THEN 'higher' ELSE 'lower' END || ' mortality.'
         ELSE upper(finding[1]) || finding[2:] || ' showed no significant association with mortality.' END AS sentence
FROM y""",
)
def trial_analysis(spark, sf_dir):
    """Stages 2 and 3: everything derived from the table; the findings as they are reported."""
    names = ["finding", "endpoint", "endpoint_type", "test", "n", "n_a", "n_b", "effect_label", "effect", "statistic", "p", "adjusted", "correction", "gated_out", "significant", "category", "direction", "sentence"]
    return rounded(analysed(spark, sf_dir).tables["findings"].select(*names), 4)


_LEVEL = """SELECT site AS level, count(cost) FILTER (trt_arm = 0) AS n_a, count(cost) FILTER (trt_arm = 1) AS n_b, avg(cost) FILTER (trt_arm = 0) - avg(cost) FILTER (trt_arm = 1) AS diff,
    var_samp(cost) FILTER (trt_arm = 0) / count(cost) FILTER (trt_arm = 0) AS ea, var_samp(cost) FILTER (trt_arm = 1) / count(cost) FILTER (trt_arm = 1) AS eb FROM s GROUP BY 1"""


@query(
    "trial_subgroups",
    f"""
WITH s AS (SELECT * FROM {TRIAL}), g AS ({_LEVEL}),
t AS (SELECT *, diff / sqrt(ea + eb) AS t, pow(ea + eb, 2) / (ea * ea / (n_a - 1) + eb * eb / (n_b - 1)) AS df FROM g)
SELECT 'site' AS subgroup, level, '1' AS arm, n_a, n_b, round(diff, 4) AS diff, round(t, 4) AS t, round({t_p("t", "df")}, 4) AS p, least(n_a, n_b) < 5 AS few FROM t""",
)
def trial_subgroups(spark, sf_dir):
    """Stage 2 beside the findings: the endpoint between arms at each level of the derived subgroups."""
    work = analysed(spark, sf_dir)
    return rounded(work.tables["subgroups"].select("subgroup", "level", "arm", "n_a", "n_b", "diff", "t", "p", "few"), 4)


@query("trial_ancova")
def trial_ancova(spark, sf_dir):
    return rounded(analysed(spark, sf_dir).tables["ancova"], 4)


@query("trial_power")
def trial_power(spark, sf_dir):
    return rounded(analysed(spark, sf_dir).tables["findings"].select("finding", "effect", "n_a", "n_b", "power", "adequate", "n_80", "n_90"), 4)


@query(
    "flags_screening",
    """
WITH s AS (SELECT CAST(l_returnflag = 'R' AS INT) AS e, CAST(l_linestatus = 'F' AS INT) AS finished, CAST(l_discount > 0.05 AS INT) AS cheap, CAST(l_linenumber = 1 AS INT) AS first_line FROM lineitem),
u AS (UNPIVOT s ON finished, cheap, first_line INTO NAME variable VALUE x),
c AS (
    SELECT variable, CAST(count(*) FILTER (x = 1 AND e = 1) AS DOUBLE) AS a1, CAST(count(*) FILTER (x = 1 AND e = 0) AS DOUBLE) AS a0,
        CAST(count(*) FILTER (x = 0 AND e = 1) AS DOUBLE) AS b1, CAST(count(*) FILTER (x = 0 AND e = 0) AS DOUBLE) AS b0 FROM u GROUP BY 1),
o AS (SELECT *, a1 + a0 + b1 + b0 AS n, abs(a1 * b0 - a0 * b1) AS gap, nullif(a1 * b0 / nullif(a0 * b1, 0), 0) AS ratio FROM c),
q AS (SELECT *, n * pow(gap - least(gap, n / 2), 2) / ((a1 + a0) * (b1 + b0) * (a1 + b1) * (a0 + b0)) AS chi2, 1.959963984540054 * sqrt(1 / nullif(a1, 0) + 1 / nullif(a0, 0) + 1 / nullif(b1, 0) + 1 / nullif(b0, 0)) AS reach FROM o)
SELECT variable, CAST(a1 + a0 AS BIGINT) AS n_a, CAST(b1 + b0 AS BIGINT) AS n_b, round(a1 / (a1 + a0), 4) AS rate_a, round(b1 / (b1 + b0), 4) AS rate_b, round(ratio, 4) AS odds_ratio,
    round(exp(ln(ratio) - reach), 4) AS low, round(exp(ln(ratio) + reach), 4) AS high, round(chi2, 4) AS chi2, round("""
    + chi2_p("chi2", "1")
    + """, 4) AS p
FROM q""",
)
def flags_screening(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_returnflag = 'R' AS INT) AS e", "CAST(l_linestatus = 'F' AS INT) AS finished", "CAST(l_discount > 0.05 AS INT) AS cheap", "CAST(l_linenumber = 1 AS INT) AS first_line")
    return rounded(analysis.flags_screened(rows, "e", ["finished", "cheap", "first_line"]), 4)


_LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIR = """SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr(x, y) AS rho FROM (
    SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y
    FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(
    "spearman_matrix",
    "WITH s AS (SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax FROM lineitem), p AS ("
    + " UNION ALL ".join(_PAIR.format(a=a, b=b) for i, a in enumerate(_LINES) for b in _LINES[i + 1 :])
    + ") SELECT a, b, n, round(rho, 6) AS rho FROM p",
)
def spearman_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity", "l_extendedprice", "l_discount", "CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax")
    return rounded(analysis.spearman_matrix(rows, _LINES))


def _counts(column: str) -> str:
    return f"SELECT 'missingness' AS section, '{column}' AS variable, 'missing' AS measure, CAST(count(*) - count({column}) AS DOUBLE) AS value FROM s"


@query(
    "static_report",
    f"""
WITH s AS (SELECT * FROM {TRIAL}), n AS (SELECT 'subject' AS v UNION ALL SELECT 'trt_arm' UNION ALL SELECT 'follow_up_days' UNION ALL SELECT 'death_event' UNION ALL SELECT unnest(['cost', 'age', 'albumin']))
SELECT section, variable, measure, round(value, 4) AS value FROM (
SELECT 'overview' AS section, NULL AS variable, 'n_rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM s
UNION ALL SELECT 'overview', NULL, 'complete', count(*) FILTER (albumin IS NOT NULL) FROM s
UNION ALL SELECT 'overview', NULL, 'n_columns', 8 UNION ALL SELECT 'overview', NULL, 'n_numeric', count(*) FROM n
UNION ALL SELECT 'duplicates', NULL, 'distinct', count(*) FROM (SELECT DISTINCT * FROM s)
UNION ALL {" UNION ALL ".join(_counts(c) for c in ("subject", "trt_arm", "follow_up_days", "death_event", *NUMBERS))}
UNION ALL {" UNION ALL ".join(f"SELECT 'statistics', '{c}', m, v FROM (SELECT avg({c}) AS mean, quantile_cont({c}, 0.5) AS p50 FROM s) UNPIVOT (v FOR m IN (mean, p50))" for c in NUMBERS)}
UNION ALL SELECT 'survival', g, 'events', e FROM (SELECT CAST(trt_arm AS VARCHAR) AS g, sum(death_event) AS e FROM s WHERE follow_up_days > 0 GROUP BY 1)
UNION ALL SELECT 'findings', v, 'n', k FROM (SELECT count(albumin) AS albumin, count(age) AS age, count(cost) AS cost, count(*) FILTER (follow_up_days > 0) AS survival_primary FROM s) UNPIVOT (k FOR v IN (albumin, age, cost, survival_primary)))""",
)
def static_report(spark, sf_dir):
    """All tables of the report are made; shown of them is what each says first, as one long table."""
    return rounded_as_sql(shown(analysis.report(trial(spark, sf_dir), PLAN)), 4)


def shown(tables: dict[str, DataFrame]) -> DataFrame:
    """section, variable, measure, value of the tables that the report begins with."""
    wanted = {"overview": (None, ["n_rows", "complete", "n_columns", "n_numeric"]), "duplicates": (None, ["distinct"]), "missingness": ("variable", ["missing"]), "survival": ("g", ["events"]), "findings": ("finding", ["n"])}
    parts = []
    for name, (variable, measures) in wanted.items():
        t = tables[name].select(F.lit(name).alias("section"), (F.col(variable) if variable else F.lit(None)).cast("string").alias("variable"), *(F.col(m).cast("double").alias(m) for m in measures))
        parts.append(t.unpivot(["section", "variable"], measures, "measure", "value"))
    t = tables["statistics"].filter(F.col("variable").isin(NUMBERS)).select(F.lit("statistics").alias("section"), "variable", "mean", "p50")
    parts.append(t.unpivot(["section", "variable"], ["mean", "p50"], "measure", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
