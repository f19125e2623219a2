"""Queries of roles, findings and report comparison over the standard tables, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import comparison, dataset, evidence, features, findings, longitudinal, roles, verification
from cohortlake.plans.queries import query, rounded, table
from cohortlake.plans.tails import t_p

_TRIAL = ["o_orderkey AS subject", "o_custkey % 2 AS trt_arm", "o_custkey % 40 AS follow_up_days", "CAST(o_orderstatus = 'F' AS INT) AS death_event", "o_totalprice AS cost", "o_custkey % 100 AS age", "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1000 END AS albumin", "o_orderpriority AS site"]
TRIAL = f"(SELECT {', '.join(_TRIAL)} FROM orders)"


def trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under clinical names."""
    return table(spark, sf_dir, "orders").selectExpr(*_TRIAL)


@query(
    "column_roles",
    f"""SELECT 'endpoint' AS role, CASE WHEN count(DISTINCT death_event) <= 3 THEN 'death_event' END AS variable FROM {TRIAL} UNION ALL SELECT 'arm', CASE WHEN count(DISTINCT trt_arm) BETWEEN 2 AND 6 THEN 'trt_arm' END FROM {TRIAL}
    UNION ALL SELECT 'time', 'follow_up_days' FROM (SELECT column_name FROM (DESCRIBE {TRIAL[1:-1]}) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND list_has_any(string_split(column_name, '_'), ['follow', 'time', 'days']))
    UNION ALL SELECT 'event', CASE WHEN bool_and(death_event IN (0, 1)) THEN 'death_event' END FROM {TRIAL}""",
)
def column_roles(spark, sf_dir):
    return roles.role_table(trial(spark, sf_dir))


@query("kept_columns", f"SELECT subject, trt_arm, follow_up_days, death_event, round(cost, 6) AS cost, age, site FROM {TRIAL}")
def kept_columns(spark, sf_dir):
    return rounded(roles.kept_columns(trial(spark, sf_dir), roles.protected(trial(spark, sf_dir), important=["Follow-up days"])))


@query(
    "group_comparison",
    f"""WITH s AS (SELECT count(cost) FILTER (trt_arm = 0) AS na, count(cost) FILTER (trt_arm = 1) AS nb, avg(cost) FILTER (trt_arm = 0) AS ma, avg(cost) FILTER (trt_arm = 1) AS mb, var_samp(cost) FILTER (trt_arm = 0) AS va, var_samp(cost) FILTER (trt_arm = 1) AS vb, count(*) - count(cost) AS dropped FROM {TRIAL}),
    x AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s)
    SELECT CASE WHEN least(na, nb) >= 30 THEN 'welch' END AS test, na AS n_a, nb AS n_b, round(t, 6) AS statistic, round(d, 6) AS effect, round({t_p("t", "df")}, 6) AS p, dropped, {t_p("t", "df")} < 0.05 AS significant FROM x""",
)
def group_comparison(spark, sf_dir):
    return rounded(findings.compare_groups(trial(spark, sf_dir), "cost", "trt_arm", 0, 1))


_STUDY = "SELECT l_returnflag AS study, l_suppkey AS k, (l_suppkey % 37) / 500.0 + min(l_discount) / 10 AS p FROM lineitem GROUP BY 1, 2"


@query(
    "gated_endpoints",
    f"""WITH f AS (SELECT *, CASE WHEN k IN (1, 2, 74) THEN 'primary' ELSE 'secondary' END AS endpoint_type FROM ({_STUDY}) WHERE NOT (study = 'A' AND k <> 2 AND k IN (1, 74))),
    b AS (SELECT *, count(*) OVER w AS m, row_number() OVER (PARTITION BY study, endpoint_type ORDER BY p, k) AS rk FROM f WINDOW w AS (PARTITION BY study, endpoint_type)),
    a AS (SELECT *, least(p * m, 1) AS bonf, min(least(p * m / rk, 1)) OVER (PARTITION BY study, endpoint_type ORDER BY rk DESC ROWS UNBOUNDED PRECEDING) AS bh FROM b),
    g AS (SELECT *, bool_or(endpoint_type = 'primary' AND bonf < 0.05) OVER (PARTITION BY study) AS won FROM a),
    x AS (SELECT *, CASE WHEN endpoint_type = 'primary' THEN bonf WHEN won THEN bh END AS adjusted FROM g)
    SELECT study, k, round(p, 6) AS p, endpoint_type, round(adjusted, 6) AS adjusted, endpoint_type = 'secondary' AND NOT won AS gated_out, coalesce(adjusted < 0.05, false) AS significant FROM x""",
)
def gated_endpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("study"), F.col("l_suppkey").alias("k")).agg(F.min("l_discount").alias("d")).select("study", "k", ((F.col("k") % 37) / 500.0 + F.col("d") / 10).alias("p"))
    rows = rows.filter("NOT (study = 'A' AND k IN (1, 74))")
    return rounded(findings.corrected(findings.endpoint_types(rows, "k", [1, 2, 74]), "k", "p", ["study"]))


def _side(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Findings of a report on each line number: does the quantity of a brand differ?"""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_brand"), "l_partkey")
    s = rows.groupBy("l_linenumber", "p_brand").agg(F.count_if(F.col("l_linestatus") == flag).alias("n"), F.sum(F.when(F.col("l_linestatus") == flag, F.col("l_quantity"))).alias("q"), F.count(F.lit(1)).alias("all"))
    return s.selectExpr(
        "cast(l_linenumber AS long) AS report", "concat(l_linenumber, '-', p_brand) AS key", "CASE WHEN n % 11 = 0 THEN NULL ELSE lower(p_brand) END AS variable", "CASE WHEN n % 3 = 0 THEN 'mortality' WHEN n % 3 = 1 THEN 'survival' END AS endpoint",
        "CASE WHEN n % 2 = 0 THEN 'group_difference' ELSE 'association' END AS claim_type", "concat(p_brand, ' quantity differs by line status in ', n, ' lines') AS text", "CASE WHEN n % 5 > 0 THEN n % 4 < 2 END AS significant",
        "CASE WHEN n % 7 < 3 THEN 'positive' WHEN n % 7 < 5 THEN 'negative' WHEN n % 7 = 5 THEN 'none' ELSE 'unknown' END AS direction", "CASE WHEN n % 6 > 0 THEN (n % 50 + 1) / 500.0D END AS p", "CASE WHEN n % 9 > 0 THEN q / n / 25.0D END AS effect",
        "CASE WHEN n % 4 = 3 THEN 'cohen_d' ELSE 'odds_ratio' END AS effect_label", "CASE WHEN n % 8 > 1 THEN q / n / 25.0D - (n % 5) / 10.0D END AS ci_low", "CASE WHEN n % 8 > 1 THEN q / n / 25.0D + (n % 5) / 10.0D END AS ci_high",
        "CASE WHEN n % 10 < 4 THEN 'group_difference' WHEN n % 10 < 7 THEN 'categorical_association' WHEN n % 10 < 9 THEN 'correlation' END AS test_family", "CASE WHEN n % 3 = 0 THEN n % 4 END AS rank",
    ).withColumn("rank", F.col("rank").cast("int"))


_SIDE = """SELECT CAST(l_linenumber AS BIGINT) AS report, CAST(l_linenumber AS VARCHAR) || '-' || p_brand AS key, CASE WHEN n % 11 = 0 THEN NULL ELSE lower(p_brand) END AS variable, CASE WHEN n % 3 = 0 THEN 'mortality' WHEN n % 3 = 1 THEN 'survival' END AS endpoint,
    CASE WHEN n % 5 > 0 THEN n % 4 < 2 END AS significant, CASE WHEN n % 7 < 3 THEN 'positive' WHEN n % 7 < 5 THEN 'negative' WHEN n % 7 = 5 THEN 'none' ELSE 'unknown' END AS direction,
    CASE WHEN n % 6 > 0 THEN (n % 50 + 1) / 500.0 END AS p, CASE WHEN n % 9 > 0 THEN q / n / 25.0 END AS effect, CASE WHEN n % 4 = 3 THEN 'cohen_d' ELSE 'odds_ratio' END AS effect_label,
    CASE WHEN n % 8 > 1 THEN q / n / 25.0 - (n % 5) / 10.0 END AS ci_low, CASE WHEN n % 8 > 1 THEN q / n / 25.0 + (n % 5) / 10.0 END AS ci_high,
    CASE WHEN n % 10 < 4 THEN 'group_difference' WHEN n % 10 < 7 THEN 'categorical_association' WHEN n % 10 < 9 THEN 'correlation' END AS test_family, CASE WHEN n % 3 = 0 THEN n % 4 END AS rank
    FROM (SELECT l_linenumber, p_brand, count(*) FILTER (l_linestatus = '{f}') AS n, sum(l_quantity) FILTER (l_linestatus = '{f}') AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_AGREED = f"""l AS ({_SIDE.format(f="F")}), r AS ({_SIDE.format(f="O")}),
j AS (SELECT l.report, l.key, l.endpoint AS le, r.endpoint AS re, l.significant AS ls, r.significant AS rs, l.direction AS ld, r.direction AS rd, l.p AS lp, r.p AS rp, l.effect AS x, r.effect AS y, l.effect_label AS lx, r.effect_label AS rx,
    l.ci_low AS la, l.ci_high AS lb, r.ci_low AS ra, r.ci_high AS rb, l.test_family AS lt, r.test_family AS rt, l.rank AS lr, r.rank AS rr, coalesce(l.p, l.effect, l.ci_low, l.rank) IS NOT NULL AND coalesce(r.p, r.effect, r.ci_low, r.rank) IS NOT NULL AS ok FROM l JOIN r ON l.report = r.report AND l.key = r.key WHERE l.variable = r.variable),
k AS (SELECT *, CASE WHEN ls <> rs THEN 'contradict' WHEN ls AND rs AND ld IN ('positive', 'negative') AND rd IN ('positive', 'negative') AND ld <> rd THEN 'contradict'
    WHEN ls = rs AND (ld = 'unknown' OR rd = 'unknown' OR ld = rd) THEN 'agree' ELSE 'partial_agree' END AS first,
    coalesce(ls, lp < 0.05) AS sl, coalesce(rs, rp < 0.05) AS sr, CASE WHEN coalesce(lx, rx) = 'odds_ratio' THEN 1 ELSE 0 END AS nul FROM j),
s AS (SELECT *, CASE WHEN sl IS NULL OR sr IS NULL THEN NULL WHEN sl = sr THEN 1.0 ELSE 0.0 END AS s1,
    CASE WHEN ld = 'unknown' OR rd = 'unknown' THEN NULL WHEN ld = rd THEN 1.0 WHEN ld = 'none' OR rd = 'none' THEN 0.5 WHEN sl AND sr THEN 0.0 ELSE 0.4 END AS s2,
    CASE WHEN x IS NULL OR y IS NULL OR lx <> rx THEN NULL WHEN lx = 'odds_ratio' AND (x - 1) * (y - 1) < 0 THEN 0.0 WHEN lx = 'cohen_d' AND x * y < 0 THEN 0.0
      WHEN CASE WHEN lx = 'odds_ratio' THEN abs(ln(x) - ln(y)) <= 0.25 ELSE abs(x - y) <= 0.1 END THEN 1.0 WHEN CASE WHEN lx = 'odds_ratio' THEN abs(ln(x) - ln(y)) <= 0.7 ELSE abs(x - y) <= 0.3 END THEN 0.65 ELSE 0.2 END AS s3,
    CASE WHEN lp IS NULL OR rp IS NULL THEN NULL WHEN (lp < 0.05) <> (rp < 0.05) THEN 0.0 WHEN abs(log10(lp) - log10(rp)) <= 0.5 THEN 1.0 WHEN abs(log10(lp) - log10(rp)) <= 1 THEN 0.7 ELSE 0.4 END AS s4,
    CASE WHEN la IS NULL OR lb IS NULL OR ra IS NULL OR rb IS NULL THEN NULL WHEN greatest(la, ra) <= least(lb, rb) THEN CASE WHEN (lb < nul OR la > nul) = (rb < nul OR ra > nul) THEN 1.0 ELSE 0.65 END
      WHEN (lb < nul OR la > nul) <> (rb < nul OR ra > nul) THEN 0.35 ELSE 0.45 END AS s5,
    CASE WHEN lt IS NULL AND rt IS NULL THEN NULL WHEN lt IS NULL OR rt IS NULL THEN 0.5 WHEN lt = rt THEN 1.0 WHEN least(lt, rt) = 'categorical_association' AND greatest(lt, rt) = 'group_difference' THEN 0.7 ELSE 0.3 END AS s6,
    CASE WHEN lr IS NULL OR rr IS NULL THEN NULL WHEN lr = rr THEN 1.0 WHEN abs(lr - rr) = 1 THEN 0.6 ELSE 0.25 END AS s7 FROM k),
w AS (SELECT *, CASE WHEN ok THEN 0.25 * CAST(s1 IS NOT NULL AS INT) + 0.2 * CAST(s2 IS NOT NULL AS INT) + 0.25 * CAST(s3 IS NOT NULL AS INT) + 0.1 * CAST(s4 IS NOT NULL AS INT) + 0.15 * CAST(s5 IS NOT NULL AS INT) + 0.05 * CAST(s6 IS NOT NULL AS INT) + 0.05 * CAST(s7 IS NOT NULL AS INT) ELSE 0 END AS weight,
    0.25 * coalesce(s1, 0) + 0.2 * coalesce(s2, 0) + 0.25 * coalesce(s3, 0) + 0.1 * coalesce(s4, 0) + 0.15 * coalesce(s5, 0) + 0.05 * coalesce(s6, 0) + 0.05 * coalesce(s7, 0) AS total FROM s),
a AS (SELECT *, round(CASE WHEN weight > 0 THEN total / weight END, 6) AS agreement, round(weight / CASE WHEN ok AND s7 IS NOT NULL THEN 1.05 ELSE 1.0 END, 6) AS coverage FROM w),
z AS (SELECT *, CASE WHEN agreement IS NULL THEN 'not_assessed' WHEN s1 = 0 OR s2 = 0 OR s3 = 0 OR s4 = 0 THEN 'contradiction' WHEN agreement >= 0.85 THEN 'strong' WHEN agreement >= 0.6 THEN 'moderate' ELSE 'weak' END AS label FROM a),
y AS (SELECT report, key, CASE WHEN label = 'contradiction' THEN 'contradict' WHEN first = 'agree' AND label IN ('weak', 'moderate') AND (s3 IN (0.2, 0.0) OR s4 = 0.4) THEN 'partial_agree' ELSE first END AS relation, agreement, coverage, label, ls, rs FROM z)"""


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    left, right = _side(spark, sf_dir, "F"), _side(spark, sf_dir, "O")
    pairs = comparison.candidates(left, right).filter("l_variable = r_variable AND l_key = r_key")
    return left, right, comparison.settled(comparison.agreement(comparison.relation(pairs)))


@query("report_agreement", f"WITH {_AGREED} SELECT report, key, relation, agreement, coverage, label AS agreement_label FROM y")
def report_agreement(spark, sf_dir):
    _, _, m = _matched(spark, sf_dir)
    return rounded(m.select("report", F.col("l_key").alias("key"), "relation", "agreement", "coverage", "agreement_label"))


@query(
    "report_metrics",
    f"""WITH {_AGREED}, t AS (SELECT report, count(*) AS pairs, count(*) FILTER (relation = 'agree') AS agree, count(*) FILTER (relation = 'partial_agree') AS partial, count(*) FILTER (relation = 'contradict') AS contradict, round(avg(agreement), 4) AS mean_agreement, round(avg(coverage), 4) AS mean_coverage,
    CAST(count(*) FILTER (ls AND rs) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT ls AND NOT rs) AS DOUBLE) AS tn, CAST(count(*) FILTER (ls AND NOT rs) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT ls AND rs) AS DOUBLE) AS fn FROM y GROUP BY 1),
    n AS (SELECT report, count(*) AS lefts, (SELECT count(*) FROM r WHERE r.report = l.report) AS rights FROM l GROUP BY report),
    u AS (SELECT *, round(pairs / lefts, 4) AS precision, round(pairs / rights, 4) AS recall FROM n JOIN t USING (report))
    SELECT report, lefts, rights, pairs, lefts - pairs AS left_only, rights - pairs AS right_only, precision, recall, round(2 * precision * recall / (precision + recall), 4) AS f1, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 4) AS mcc,
    round((lefts - pairs) / lefts, 4) AS novel, agree, partial, contradict, round(agree / pairs, 4) AS agree_rate, round(contradict / pairs, 4) AS contradict_rate, mean_agreement, mean_coverage FROM u""",
)
def report_metrics(spark, sf_dir):
    return rounded(comparison.metrics(*_matched(spark, sf_dir)))


@query("report_pairs")
def report_pairs(spark, sf_dir):
    left, right = _side(spark, sf_dir, "F"), _side(spark, sf_dir, "O")
    return rounded(comparison.assigned(comparison.candidates(left, right)).select("report", "l_key", "r_key", "score"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as subjects, their lines as visits."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS subject", "l_linenumber AS visit", "l_orderkey % 2 AS arm", "CASE WHEN l_partkey % 13 > 0 THEN l_quantity + 3 * (l_orderkey % 7) END AS y", "l_discount")


@query("mixed_model")
def mixed_model(spark, sf_dir):
    return rounded(longitudinal.repeated_measures_model(visits(spark, sf_dir), "subject", "visit", "arm", "y", ["l_discount"]), 4)


@query("constrained_model")
def constrained_model(spark, sf_dir):
    return rounded(longitudinal.constrained_model(visits(spark, sf_dir), "subject", "visit", "arm", "y"), 4)


@query("imputation")
def imputation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price", "CASE WHEN o_custkey % 7 > 0 THEN o_totalprice / 1000 + o_custkey % 10 END AS score", "o_custkey % 10 AS x")
    filled = longitudinal.imputed(rows, "o_orderkey", ["price", "score"], ["x"], copies=3, sweeps=3)
    return rounded(longitudinal.pooled(filled, ["price", "score"]), 4)


@query(
    "concordance",
    f"""WITH s AS (SELECT follow_up_days AS t, death_event AS e, age // 10 AS r FROM {TRIAL} WHERE follow_up_days > 0), c AS (SELECT t, r, CAST(sum(e) AS BIGINT) AS d, count(*) AS c FROM s GROUP BY 1, 2),
    p AS (SELECT a.d, a.r AS ra, b.r AS rb, CASE WHEN b.t > a.t THEN b.c ELSE b.c - b.d END AS n FROM c a JOIN c b ON b.t >= a.t WHERE a.d > 0),
    x AS (SELECT CAST(sum(d * n) AS BIGINT) AS pairs, CAST(coalesce(sum(d * n) FILTER (ra > rb), 0) AS BIGINT) AS concordant, CAST(coalesce(sum(d * n) FILTER (ra = rb), 0) AS BIGINT) AS tied FROM p)
    SELECT *, round((concordant + 0.5 * tied) / pairs, 6) AS c_index FROM x""",
)
def concordance(spark, sf_dir):
    rows = trial(spark, sf_dir).withColumn("risk", F.floor(F.col("age") / 10))
    return rounded(longitudinal.concordance(rows, "follow_up_days", "death_event", "risk"))


_SCREENED = "SELECT '{c}' AS v, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM (SELECT count({c}) FILTER (death_event = 1) AS na, count({c}) FILTER (death_event = 0) AS nb, avg({c}) FILTER (death_event = 1) AS ma, avg({c}) FILTER (death_event = 0) AS mb, var_samp({c}) FILTER (death_event = 1) AS va, var_samp({c}) FILTER (death_event = 0) AS vb FROM {t})"


@query(
    "claim_verification",
    f"""WITH x AS (SELECT v, {t_p("t", "df")} AS p, t FROM ({_SCREENED.format(c="cost", t=TRIAL)} UNION ALL {_SCREENED.format(c="age", t=TRIAL)})),
    k AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'cost' WHEN s_suppkey % 3 = 1 THEN 'age' END AS v, s_suppkey % 2 = 0 AS yes, CASE WHEN s_suppkey % 3 < 2 THEN 'continuous_group_difference' ELSE 'continuous_group_difference' END AS family FROM supplier)
    SELECT k AS s_suppkey, k.v AS variable, family, round(p, 6) AS p, CASE WHEN p IS NULL THEN 'unsupported' WHEN yes <> (p < 0.05) THEN 'contradicted' WHEN yes AND t < 0 THEN 'contradicted' WHEN yes AND p > 0.04 + greatest(0.001, 0.01) THEN 'partial' ELSE CASE WHEN yes AND abs(p - 0.04) > 0.01 THEN 'partial' ELSE 'verified' END END AS verdict FROM k LEFT JOIN x ON k.v = x.v""",
)
def claim_verification(spark, sf_dir):
    said = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat(CASE s_suppkey % 3 WHEN 0 THEN 'Cost' WHEN 1 THEN 'The age' ELSE 'Blood pressure' END, CASE WHEN s_suppkey % 2 = 0 THEN ' was significantly higher in those who died (p = 0.04).' ELSE ' did not show a difference, it was not significant.' END) AS claim")
    out = verification.verify(evidence.reported(said, "claim"), "claim", trial(spark, sf_dir), event="death_event", arm="trt_arm", time="follow_up_days")
    return rounded(out.select("s_suppkey", "variable", "family", "p", "verdict"))


_SHOWN = "(SELECT o_orderkey AS subject_id, o_custkey AS site_id, o_totalprice AS price, o_totalprice / 2 + o_custkey % 50 AS half, 1.0 AS one, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 7 END AS week, o_orderstatus AS status FROM orders)"
_FAR = "SELECT 'outlier', '{c}@' || subject_id, {c} FROM (SELECT subject_id, {c}, quantile_cont({c}, 0.25) OVER () AS a, quantile_cont({c}, 0.75) OVER () AS b FROM t) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) QUALIFY row_number() OVER (ORDER BY abs({c} - (a + b) / 2) DESC, subject_id) <= 3"


@query(
    "dataset_evidence",
    f"""WITH t AS (SELECT * FROM {_SHOWN}), e AS (SELECT 'missing' AS kind, 'week' AS subject, 100.0 * (count(*) - count(week)) / count(*) AS value FROM t UNION ALL SELECT 'repeated_id', 'site_id', sum(c) FROM (SELECT count(*) AS c FROM t GROUP BY site_id) WHERE c > 1
    UNION ALL SELECT 'constant', 'one', min(one) FROM t HAVING count(DISTINCT one) = 1 {"".join(f" UNION ALL SELECT * FROM ({_FAR.format(c=c)})" for c in ("price", "half", "week"))}
    UNION ALL SELECT 'top_correlations', '(price, half)', corr(price, half) FROM t UNION ALL SELECT 'top_correlations', '(price, week)', corr(price, week) FROM t UNION ALL SELECT 'top_correlations', '(half, week)', corr(half, week) FROM t
    UNION ALL SELECT 'share', 'status=' || status, count(*) / (SELECT count(*) FROM t) FROM t GROUP BY status)
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY abs(value) DESC, subject) - 1 AS place, subject, round(value, 6) AS value, kind || '[' || (row_number() OVER (PARTITION BY kind ORDER BY abs(value) DESC, subject) - 1) || ']: ' || subject || '=' || format('{{:,.4f}}', value) AS citation FROM e""",
)
def dataset_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS subject_id", "o_custkey AS site_id", "o_totalprice AS price", "o_totalprice / 2 + o_custkey % 50 AS half", "1D AS one", "CASE WHEN o_orderkey % 4 > 0 THEN o_custkey % 7 END AS week", "o_orderstatus AS status")
    return rounded(dataset.evidence(rows, "subject_id"))


_FIVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("selection_stability")
def selection_stability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rounded(features.stability(rows, "key", "l_returnflag", _FIVE, size=3))


@query(
    "pair_strengths",
    "WITH p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS v FROM lineitem" for i, a in enumerate(_FIVE) for b in _FIVE[i + 1 :])
    + " UNION ALL SELECT 'l_returnflag', 'l_linestatus', sqrt(sum((o - e) * (o - e) / e) / (max(n) * 1)) FROM (SELECT coalesce(o, 0) AS o, ra * cb / n AS e, n FROM (SELECT l_returnflag AS r, count(*) AS ra FROM lineitem GROUP BY 1) CROSS JOIN (SELECT l_linestatus AS c, count(*) AS cb FROM lineitem GROUP BY 1) CROSS JOIN (SELECT count(*) AS n FROM lineitem) LEFT JOIN (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS o FROM lineitem GROUP BY 1, 2) USING (r, c))) SELECT a, b, round(v / max(v) OVER (), 6) AS strength FROM p",
)
def pair_strengths(spark, sf_dir):
    return rounded(features.pair_strengths(table(spark, sf_dir, "lineitem"), _FIVE, ["l_returnflag", "l_linestatus"]))
