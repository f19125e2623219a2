"""Queries of the analytical operators over the standard tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import association as assoc
from cohortlake.operators import evidence, profile, regression, survival
from cohortlake.plans.tails import chi2_p, f_p, t_p, z_p

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in df.dtypes))


def rounded_as_sql(df: DataFrame, digits: int = 6) -> DataFrame:
    """As ``rounded``, with doubles rounded as DuckDB does: scaled, then to whole numbers. ``F.round`` goes by the printed decimal, so the two part
    at some values that are printed as ties, as medians of few digits often are."""
    scale = float(10**digits)
    return rounded(df.select(*((F.round(F.col(c) * scale) / scale).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes)), digits)


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with values missing by rule."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_returnflag", "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS a", "CASE WHEN l_partkey % 5 > 1 THEN l_extendedprice END AS b", "CASE WHEN l_suppkey % 9 = 0 THEN l_tax END AS c")


MASKED = "(SELECT l_orderkey, l_returnflag, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 5 > 1 THEN l_extendedprice END AS b, CASE WHEN l_suppkey % 9 = 0 THEN l_tax END AS c FROM lineitem)"


@query("value_counts", "SELECT event_type AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_counts(spark, sf_dir):
    return rounded(profile.value_counts(table(spark, sf_dir, "events"), "event_type"))


@query("group_summary", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(quantile_cont({c}, 0.5), 4) AS {c}_median, count({c}) AS {c}_count, round(stddev_samp({c}), 4) AS {c}_std" for c in ("l_quantity", "l_extendedprice")) + " FROM lineitem GROUP BY 1, 2")
def group_summary(spark, sf_dir):
    return rounded(profile.group_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice"]), 4)


@query("column_statistics", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, " + ", ".join(f"round(quantile_cont({c}, {q / 100}), 4) AS p{q}" for q in (5, 25, 50, 75, 95)) + f", count(*) FILTER ({c} = 0) AS zeros FROM {MASKED}" for c in "abc"))
def column_statistics(spark, sf_dir):
    return rounded(profile.column_statistics(masked(spark, sf_dir), ["a", "b", "c"]), 4)


@query("histogram", "WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), c AS (SELECT least(CAST(floor((o_totalprice - a) / ((b - a) / 20)) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM orders, e GROUP BY 1) SELECT g.bin, round(a + (g.bin - 1) * (b - a) / 20, 4) AS low, coalesce(n, 0) AS count FROM e, (SELECT unnest(range(1, 21)) AS bin) g LEFT JOIN c ON g.bin = c.bin")
def histogram(spark, sf_dir):
    return rounded(profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("entropy", "WITH c AS (SELECT p_brand, count(*) AS c FROM part WHERE p_brand IS NOT NULL GROUP BY 1), t AS (SELECT sum(c) AS t FROM c) SELECT count(*) AS \"distinct\", round(-sum(c / t * log2(c / t + 1e-12)), 6) AS entropy, round(log2(count(*)), 6) AS most, round(count(*) / max(t), 6) AS ratio FROM c, t")
def entropy(spark, sf_dir):
    return rounded(profile.entropy(table(spark, sf_dir, "part"), "p_brand"))


@query("missingness_tiers", " UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent, CASE WHEN 100.0 * (count(*) - count({c})) / count(*) > 50 THEN 'excluded' WHEN 100.0 * (count(*) - count({c})) / count(*) >= 20 THEN 'high_missingness_section' ELSE 'listwise_deletion' END AS tier FROM {MASKED}" for c in "abc"))
def missingness_tiers(spark, sf_dir):
    return rounded(profile.missingness(masked(spark, sf_dir), ["a", "b", "c"]))


@query("missing_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)), 6) AS r FROM {MASKED}" for a, b in (("a", "b"), ("a", "c"), ("b", "c"))))
def missing_correlation(spark, sf_dir):
    return rounded(profile.missing_correlation(masked(spark, sf_dir), ["a", "b", "c"]))


_NULLS = "SELECT o_orderkey AS key, CAST(o_custkey % 7 = 0 AS INT) + CAST(o_orderkey % 11 = 0 AS INT) + CAST(o_custkey % 5 = 1 AS INT) AS nulls FROM orders"


@query("missing_rows", f"WITH r AS ({_NULLS}) SELECT row_number() OVER (ORDER BY nulls DESC, key) AS rank, key, nulls, (SELECT count(*) FROM r WHERE nulls > 0) AS incomplete, (SELECT count(*) FROM r WHERE nulls = 0) AS complete FROM (SELECT * FROM r WHERE nulls > 0 ORDER BY nulls DESC, key LIMIT 5)")
def missing_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 7 <> 0 THEN 1 END AS a", "CASE WHEN o_orderkey % 11 <> 0 THEN 1D END AS b", "CASE WHEN o_custkey % 5 <> 1 THEN 'x' END AS c")
    return rounded(profile.missing_rows(rows, "o_orderkey", ["a", "b", "c"]))


@query("category_profile", " UNION ALL ".join(f"SELECT '{c}' AS variable, rank, value, count, first_value(value) OVER (ORDER BY rank) AS mode FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, {c} AS value, count(*) AS count FROM part GROUP BY {c}) WHERE rank <= 10" for c in ("p_brand", "p_type")))
def category_profile(spark, sf_dir):
    return rounded(profile.categories(table(spark, sf_dir, "part"), ["p_brand", "p_type"]))


@query("subject_repeats", "WITH c AS (SELECT user_id AS subject, count(*) AS c FROM events GROUP BY 1) SELECT row_number() OVER (ORDER BY c DESC, subject) AS rank, subject, c, (SELECT count(*) FROM c) AS subjects, (SELECT max(c) FROM c) AS most, round((SELECT avg(c) FROM c), 6) AS mean FROM (SELECT * FROM c ORDER BY c DESC, subject LIMIT 5)")
def subject_repeats(spark, sf_dir):
    return rounded(profile.repeats(table(spark, sf_dir, "events"), "user_id"))


@query("outlier_examples", "SELECT 'value' AS variable, row_number() OVER (ORDER BY abs(v - (q1 + q3) / 2) DESC, event_id) AS rank, event_id AS key, round(v, 6) AS value FROM (SELECT event_id, value AS v, quantile_cont(value, 0.25) OVER () AS q1, quantile_cont(value, 0.75) OVER () AS q3 FROM events) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) QUALIFY rank <= 10")
def outlier_examples(spark, sf_dir):
    return rounded(profile.outlier_examples(table(spark, sf_dir, "events"), "event_id", ["value"]))


@query("baseline_categories", " UNION ALL ".join(f"SELECT '{c}' AS variable, level, round(p1, 6) AS share_1, round(p2, 6) AS share_2, CASE WHEN levels = 2 AND level = first THEN round((p1 - p2) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2), 6) END AS smd, CASE WHEN levels = 2 AND level = first THEN abs((p1 - p2) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2)) > 0.1 END AS flagged FROM (SELECT {c} AS level, count(*) FILTER (o_orderstatus = 'F') / sum(count(*) FILTER (o_orderstatus = 'F')) OVER () AS p1, count(*) FILTER (o_orderstatus = 'O') / sum(count(*) FILTER (o_orderstatus = 'O')) OVER () AS p2, count(*) OVER () AS levels, min({c}) OVER () AS first FROM (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS price FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY {c})" for c in ("o_orderpriority", "price")))
def baseline_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus IN ('F', 'O')").withColumn("price", F.when(F.col("o_totalprice") > 150000, "high").otherwise("low"))
    return rounded(profile.balance_categories(rows, "o_orderstatus", ["o_orderpriority", "price"]))


@query("duplicate_checks", "WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS rows, count(*) FILTER (c > 1) AS keys, count(*) AS \"distinct\", max(c) AS most FROM c")
def duplicate_checks(spark, sf_dir):
    return rounded(profile.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("outliers", " UNION ALL ".join(f"SELECT '{c}' AS variable, max(n) AS n, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS iqr, count(*) FILTER (abs(v - mean) > 3 * sd) AS zscore, count(*) FILTER (m > 0 AND 0.6745 * abs(v - q2) / m > 3.5) AS mad FROM (SELECT *, quantile_cont(abs(v - q2), 0.5) OVER () AS m FROM (SELECT {c} AS v, quantile_cont({c}, 0.25) OVER () AS q1, quantile_cont({c}, 0.5) OVER () AS q2, quantile_cont({c}, 0.75) OVER () AS q3, avg({c}) OVER () AS mean, stddev_samp({c}) OVER () AS sd, count(*) OVER () AS n FROM events WHERE {c} IS NOT NULL))" for c in ("value", "user_id")))
def outliers(spark, sf_dir):
    return rounded(profile.outliers(table(spark, sf_dir, "events"), ["value", "user_id"]))


@query("digit_preference", "WITH d AS (SELECT CAST(round_even(abs(o_totalprice), 0) AS BIGINT) % 10 AS d, count(*) AS c FROM orders GROUP BY 1) SELECT 'o_totalprice' AS variable, CAST(sum(c) AS BIGINT) AS n, round(10.0 * sum(c * c) / sum(c) - sum(c), 6) AS chi2, (SELECT d FROM d ORDER BY c DESC, d LIMIT 1) AS dominant, round(" + chi2_p("(10.0 * sum(c * c) / sum(c) - sum(c))", "9") + ", 6) AS p, " + chi2_p("(10.0 * sum(c * c) / sum(c) - sum(c))", "9") + " < 0.05 AS flagged FROM d")
def digit_preference(spark, sf_dir):
    return rounded(profile.digit_preference(table(spark, sf_dir, "orders"), ["o_totalprice"]))


@query("baseline_balance", " UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) FILTER (l_linestatus = 'F') AS n_1, count({c}) FILTER (l_linestatus = 'O') AS n_2, round(avg({c}) FILTER (l_linestatus = 'F'), 6) AS mean_1, round(avg({c}) FILTER (l_linestatus = 'O'), 6) AS mean_2, round((avg({c}) FILTER (l_linestatus = 'F') - avg({c}) FILTER (l_linestatus = 'O')) / sqrt((var_samp({c}) FILTER (l_linestatus = 'F') + var_samp({c}) FILTER (l_linestatus = 'O')) / 2), 6) AS smd, abs((avg({c}) FILTER (l_linestatus = 'F') - avg({c}) FILTER (l_linestatus = 'O')) / sqrt((var_samp({c}) FILTER (l_linestatus = 'F') + var_samp({c}) FILTER (l_linestatus = 'O')) / 2)) > 0.1 AS flagged FROM lineitem" for c in ("l_quantity", "l_discount")))
def baseline_balance(spark, sf_dir):
    return rounded(profile.balance(table(spark, sf_dir, "lineitem"), "l_linestatus", ["l_quantity", "l_discount"]))


@query("crosstab", "SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab(spark, sf_dir):
    return rounded(profile.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


_R = "WITH x AS (SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM {t}) SELECT a, b, n, round(r, 6) AS r, round({p}, 6) AS p FROM x"


@query("correlation_matrix", " UNION ALL ".join(f"SELECT * FROM ({_R.format(a=a, b=b, t=MASKED, p=t_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)'))})" for a, b in (("a", "b"), ("a", "c"), ("b", "c"))))
def correlation_matrix(spark, sf_dir):
    return rounded(assoc.correlation_tests(masked(spark, sf_dir), ["a", "b", "c"]))


@query("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r")
def spearman(spark, sf_dir):
    return rounded(assoc.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"))


@query("chi_square", "WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), y AS (SELECT b, sum(o) AS cb FROM o GROUP BY 1), w AS (SELECT sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM o), g AS (SELECT coalesce(o.o, 0) AS o, ra * cb / n AS e, n, r, c FROM x, y, w LEFT JOIN o ON o.a = x.a AND o.b = y.b), z AS (SELECT CAST(n AS BIGINT) AS n, sum((o - e) * (o - e) / e) AS chi2, (r - 1) * (c - 1) AS df, min(e) AS least, sqrt(sum((o - e) * (o - e) / e) / (n * (least(r, c) - 1))) AS v FROM g GROUP BY n, r, c) SELECT n, round(chi2, 6) AS chi2, df, round(least, 6) AS min_expected, round(v, 6) AS cramers_v, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'medium' ELSE 'large' END AS magnitude, round(" + chi2_p("chi2", "df") + ", 6) AS p FROM z")
def chi_square(spark, sf_dir):
    return rounded(assoc.chi_square(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


_AB = ("count(v) FILTER (g = 'F') AS na, count(v) FILTER (g = 'O') AS nb, avg(v) FILTER (g = 'F') AS ma, avg(v) FILTER (g = 'O') AS mb, var_samp(v) FILTER (g = 'F') AS va, var_samp(v) FILTER (g = 'O') AS vb")


_MAGNITUDE = "CASE WHEN abs({x}) < {a} THEN 'negligible' WHEN abs({x}) < {b} THEN 'small' WHEN abs({x}) < {c} THEN 'medium' ELSE 'large' END"


@query(
    "welch_t_test",
    f"""WITH s AS (SELECT {_AB} FROM (SELECT l_extendedprice AS v, l_linestatus AS g FROM lineitem)),
    x AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s)
    SELECT na AS n_a, nb AS n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(t, 6) AS t, round(df, 4) AS df, round(d, 6) AS cohens_d, {_MAGNITUDE.format(x="d", a=0.2, b=0.5, c=0.8)} AS magnitude, round({t_p("t", "df")}, 6) AS p FROM x""",
)
def welch_t_test(spark, sf_dir):
    out = assoc.welch(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus", "F", "O")
    return rounded(out.withColumn("df", F.round("df", 4)))


_RANKED = "WITH r AS (SELECT {g} AS g, {v} AS v, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS rk FROM {t}), ties AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties, sum(c) AS n FROM (SELECT count(*) AS c FROM {t} GROUP BY {v}))"


_MW = """s AS (SELECT count(*) FILTER (g = 'F') AS na, count(*) FILTER (g = 'O') AS nb, CAST(sum(rk) FILTER (g = 'F') AS DOUBLE) AS ra FROM r),
    u AS (SELECT *, ra - na * (na + 1.0) / 2 AS u, CAST(na AS DOUBLE) * nb AS nn FROM s, ties),
    v AS (SELECT *, sign(u - nn / 2) * greatest(abs(u - nn / 2) - 0.5, 0) / sqrt(nn / 12 * ((n + 1) - ties / (CAST(n AS DOUBLE) * (n - 1)))) AS z, 2 * u / nn - 1 AS d FROM u)"""


@query("mann_whitney", f"{_RANKED.format(g='l_linestatus', v='l_quantity', t='lineitem')}, {_MW} SELECT na AS n_a, nb AS n_b, round(u, 4) AS u, round(z, 6) AS z, round({z_p('z')}, 6) AS p, round(d, 6) AS cliffs_delta, {_MAGNITUDE.format(x='d', a=0.147, b=0.33, c=0.474)} AS magnitude FROM v")
def mann_whitney(spark, sf_dir):
    out = assoc.mann_whitney(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus", "F", "O")
    return rounded(out.withColumn("u", F.round("u", 4)))


@query(
    "pairwise_groups",
    f"""WITH g AS (SELECT DISTINCT o_orderpriority AS g FROM orders), p AS (SELECT x.g AS a, y.g AS b FROM g x JOIN g y ON x.g < y.g),
    rows AS (SELECT a, b, o_orderpriority AS g, o_totalprice AS v FROM p JOIN orders ON o_orderpriority = a OR o_orderpriority = b),
    r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY a, b, v) AS c FROM rows),
    s AS (SELECT a, b, count(*) FILTER (g = a) AS na, count(*) FILTER (g = b) AS nb, CAST(sum(rk) FILTER (g = a) AS DOUBLE) AS ra, sum(CAST(c AS DOUBLE) * c - 1) AS ties, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY 1, 2),
    u AS (SELECT *, ra - na * (na + 1.0) / 2 AS u, CAST(na AS DOUBLE) * nb AS nn FROM s),
    v AS (SELECT *, sign(u - nn / 2) * greatest(abs(u - nn / 2) - 0.5, 0) / sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
    SELECT a, b, na AS n_a, nb AS n_b, round(u, 4) AS u, round(z, 6) AS z, round({z_p("z")}, 6) AS p, round(least({z_p("z")} * count(*) OVER (), 1), 6) AS p_adjusted FROM v""",
)
def pairwise_groups(spark, sf_dir):
    out = assoc.pairwise(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(out.withColumn("u", F.round("u", 4)))


@query("kruskal_wallis", f"{_RANKED.format(g='event_type', v='value', t='events')}, s AS (SELECT g, count(*) AS k, CAST(sum(rk) AS DOUBLE) AS ranks FROM r GROUP BY g), x AS (SELECT count(*) AS groups, CAST(max(n) AS BIGINT) AS n, (12 / (CAST(max(n) AS DOUBLE) * (max(n) + 1)) * sum(ranks * ranks / k) - 3 * (max(n) + 1)) / (1 - max(ties) / (pow(CAST(max(n) AS DOUBLE), 3) - max(n))) AS h FROM s, ties) SELECT groups, n, round(h, 4) AS h, round({chi2_p('h', '(groups - 1)')}, 4) AS p FROM x")
def kruskal_wallis(spark, sf_dir):
    return rounded(assoc.kruskal(table(spark, sf_dir, "events"), "value", "event_type"), 4)


@query("risk_measures", "WITH s AS (SELECT avg(CAST(o_orderstatus = 'F' AS INT)) FILTER (o_custkey % 2 = 0) AS p1, avg(CAST(o_orderstatus = 'F' AS INT)) FILTER (o_custkey % 2 = 1) AS p2 FROM orders) SELECT round(p1 - p2, 6) AS rd, round(p1 / nullif(p2, 0), 6) AS rr, round(p1 / nullif(1 - p1, 0) / nullif(p2 / nullif(1 - p2, 0), 0), 6) AS odds_ratio, round(1 / nullif(abs(p1 - p2), 0), 4) AS nnt FROM s")
def risk_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderstatus = 'F' AS INT) AS y", "o_custkey % 2 AS arm")
    return rounded(assoc.risk(rows, "y", "arm", 0, 1).withColumn("nnt", F.round("nnt", 4)))


_P = "(SELECT l_returnflag AS family, l_partkey AS k, min(l_discount) / 100 + (l_partkey % 97) / 1000.0 AS p FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1, 2)"


@query("multiplicity", f"WITH x AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, k) AS rk FROM {_P}) SELECT family, k, round(p, 6) AS p, round(least(p * m, 1), 6) AS bonferroni, round(min(least(p * m / rk, 1)) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING), 6) AS bh, round(max(least(p * (m - rk + 1), 1)) OVER (PARTITION BY family ORDER BY rk ROWS UNBOUNDED PRECEDING), 6) AS holm FROM x")
def multiplicity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("k")).agg((F.min("l_discount") / 100 + (F.col("l_partkey") % 97) / 1000.0).alias("p"))
    return rounded(assoc.adjust(rows, "p", "k", ["family"]))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a user: arm, days from the first event to the first purchase or else the last event, and which it was."""
    day = lambda c: (F.unix_timestamp(c) / 86400)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t0"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("t1"), F.max("ts").alias("t2"))
    return rows.select((F.col("user_id") % 2).alias("arm"), F.floor(day(F.coalesce("t1", "t2")) - day("t0") + 1).alias("time"), F.col("t1").isNotNull().cast("int").alias("event"))


_SUBJECTS = "subj AS (SELECT user_id % 2 AS arm, CAST(floor(CAST(floor(epoch(coalesce(t1, t2))) AS BIGINT) / 86400 - CAST(floor(epoch(t0)) AS BIGINT) / 86400 + 1) AS DOUBLE) AS time, CAST(t1 IS NOT NULL AS INT) AS event FROM (SELECT user_id, min(ts) AS t0, min(ts) FILTER (event_type = 'purchase') AS t1, max(ts) AS t2 FROM events GROUP BY 1))"
_RISK = _SUBJECTS + ", c AS (SELECT arm AS g, time AS t, CAST(sum(event) AS BIGINT) AS d, count(*) AS c FROM subj WHERE time > 0 GROUP BY 1, 2), k AS (SELECT *, CAST(sum(c) OVER (PARTITION BY g ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM c)"


@query("kaplan_meier", f"WITH {_RISK}, e AS (SELECT * FROM k WHERE d > 0) SELECT g, t, d, n, round(CASE WHEN max(CAST(d = n AS INT)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS survival FROM e WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)")
def kaplan_meier(spark, sf_dir):
    return rounded(survival.kaplan_meier(subjects(spark, sf_dir), "time", "event", "arm"))


@query(
    "log_rank",
    f"""WITH {_SUBJECTS}, s AS (SELECT arm AS g, time AS t, event AS e FROM subj WHERE time > 0), tt AS (SELECT DISTINCT t FROM s WHERE e = 1),
    x AS (SELECT tt.t, count(*) FILTER (s.t >= tt.t AND g = 0) AS n0, count(*) FILTER (s.t >= tt.t AND g = 1) AS n1, count(*) FILTER (s.t = tt.t AND e = 1 AND g = 0) AS d0, count(*) FILTER (s.t = tt.t AND e = 1 AND g = 1) AS d1 FROM tt, s GROUP BY 1),
    z AS (SELECT sum(d0) AS o, sum((d0 + d1) * n0 / (n0 + n1)) AS e, sum(CASE WHEN n0 + n1 > 1 THEN (d0 + d1) * (n0 / (n0 + n1)) * (n1 / (n0 + n1)) * (n0 + n1 - d0 - d1) / (n0 + n1 - 1) ELSE 0 END) AS v FROM x),
    c AS (SELECT pow(o - e, 2) / v AS chi2 FROM z)
    SELECT CAST(2 AS BIGINT) AS groups, round(chi2, 6) AS chi2, CAST(1 AS BIGINT) AS df, round({chi2_p("chi2", "1")}, 6) AS p FROM c""",
)
def log_rank(spark, sf_dir):
    return rounded(survival.log_rank(subjects(spark, sf_dir), "time", "event", "arm"))


@query("survival_summary", f"WITH {_RISK}, e AS (SELECT * FROM k WHERE d > 0), sv AS (SELECT g, t, CASE WHEN max(CAST(d = n AS INT)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS s FROM e WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)), a AS (SELECT arm AS g, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM subj WHERE time > 0 GROUP BY 1), m AS (SELECT g, min(t) FILTER (s <= 0.5) AS median, coalesce(arg_max(s, t) FILTER (t <= 2), 1) AS s_2, coalesce(arg_max(s, t) FILTER (t <= 7), 1) AS s_7 FROM sv GROUP BY g) SELECT a.g, n, events, n - events AS censored, round(events / n, 6) AS rate, median, round(coalesce(s_2, 1), 6) AS survival_2, round(coalesce(s_7, 1), 6) AS survival_7 FROM a LEFT JOIN m USING (g)")
def survival_summary(spark, sf_dir):
    return rounded(survival.summary(subjects(spark, sf_dir), "time", "event", "arm", [2, 7]))


#: The t that leaves 5 % outside, by Cornish and Fisher's expansion about the normal.
_EDGE = "(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * (n - 2)) + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * pow(n - 2, 2)))"


@query(
    "linear_regression",
    f"""WITH b AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b0, regr_slope(l_extendedprice, l_quantity) AS b1, regr_r2(l_extendedprice, l_quantity) AS r2, avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, count(*) AS n FROM lineitem),
    e AS (SELECT l_quantity - mx AS d, (l_extendedprice - b0 - b1 * l_quantity) / (1 - 1.0 / n - pow(l_quantity - mx, 2) / sxx) AS u, l_extendedprice - b0 - b1 * l_quantity AS r, mx, sxx, n FROM lineitem, b),
    s AS (SELECT sqrt(sum(pow(1.0 / n - mx * d / sxx, 2) * u * u)) AS s0, sqrt(sum(pow(d / sxx, 2) * u * u)) AS s1, sum(r * r) AS rss FROM e),
    x AS (SELECT 'intercept' AS term, b0 AS coef, s0 AS se, n, r2, rss, syy FROM b, s UNION ALL SELECT 'l_quantity', b1, s1, n, r2, rss, syy FROM b, s)
    SELECT term, round(coef, 4) AS coef, round(se, 6) AS se, round(coef / se, 4) AS t, round({t_p("(coef / se)", "(n - 2)")}, 6) AS p, round(coef - {_EDGE} * se, 4) AS low, round(coef + {_EDGE} * se, 4) AS high, n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adjusted_r2, round(n * (ln(2 * pi() * rss / n) + 1) + 4, 2) AS aic, round(n * (ln(2 * pi() * rss / n) + 1) + 2 * ln(n), 2) AS bic, round((syy - rss) / (rss / (n - 2)), 4) AS f, round({f_p("((syy - rss) / (rss / (n - 2)))", "1", "(n - 2)")}, 6) AS f_p FROM x""",
)
def linear_regression(spark, sf_dir):
    out = regression.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(out.select("term", F.round("coef", 4).alias("coef"), "se", F.round("t", 4).alias("t"), "p", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n", "r2", "adjusted_r2", F.round("aic", 2).alias("aic"), F.round("bic", 2).alias("bic"), F.round("f", 4).alias("f"), "f_p"))


@query("text_chunks", "SELECT doc_id, chunk, start, least(start + 512, length(text)) AS \"end\", text[start + 1 : start + 512] AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 448)) AS start, unnest(range(0, CAST(ceil(length(text) / 448) AS BIGINT))) AS chunk FROM documents) WHERE length(trim(text[start + 1 : start + 512])) >= 50")
def text_chunks(spark, sf_dir):
    return rounded(evidence.chunks(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("bm25_search", "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents), z AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d), p AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY 1, 2, 3), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))), 6) AS score FROM p JOIN q USING (term) JOIN f USING (term), z GROUP BY 1, 2) SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_search(spark, sf_dir):
    return rounded(evidence.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"))
