"""Queries of ordered work over the standard tables: pairs of continuous values, corrections of many tests at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import association, inference, longitudinal
from cohortlake.plans.queries import query, rounded, table
from cohortlake.plans.tails import t_p
from cohortlake.plans.trials import TRIAL, trial


@query(
    "concordance_continuous",
    f"""
WITH s AS (SELECT follow_up_days AS t, death_event AS e, cost AS r FROM {TRIAL} WHERE follow_up_days > 0),
p AS (
    SELECT count(*) AS pairs, count(*) FILTER (a.r > b.r) AS concordant, count(*) FILTER (a.r = b.r) AS tied
    FROM s a JOIN s b ON b.t > a.t OR (b.t = a.t AND b.e = 0) WHERE a.e = 1)
SELECT *, round((concordant + 0.5 * tied) / pairs, 6) AS c_index FROM p""",
)
def concordance_continuous(spark, sf_dir):
    return rounded(longitudinal.concordance(trial(spark, sf_dir), "follow_up_days", "death_event", "cost"))


@query(
    "kendall_continuous",
    """
WITH o AS (SELECT o_totalprice AS a, epoch(CAST(o_orderdate AS TIMESTAMP)) - o_custkey / 7.0 AS b FROM orders),
s AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s FROM o x, o y),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM o),
ta AS (SELECT coalesce(sum(k * (k - 1) / 2), 0) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM o GROUP BY a)),
tb AS (SELECT coalesce(sum(k * (k - 1) / 2), 0) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM o GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - ta.t) * (n * (n - 1) / 2 - tb.t)), 6) AS tau FROM s, n, ta, tb""",
)
def kendall_continuous(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("a"), (F.col("o_orderdate").cast("timestamp").cast("double") - F.col("o_custkey") / 7.0).alias("b"))
    return rounded(inference.kendall(rows, "a", "b"))


@query(
    "customer_screening",
    f"""
WITH o AS (SELECT *, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS d FROM orders),
t AS (
    SELECT o_custkey, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM o GROUP BY 1 HAVING count(*) > 2 AND stddev_samp(d) > 0),
p AS (SELECT o_custkey, n, {t_p("t", "(n - 1)")} AS p FROM t),
r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, o_custkey) AS k FROM p)
SELECT o_custkey, n, round(p, 4) AS p, round(least(p * m, 1), 4) AS bonferroni,
    round(min(least(p * m / k, 1)) OVER (ORDER BY k DESC), 4) AS bh, round(max(least(p * (m - k + 1), 1)) OVER (ORDER BY k), 4) AS holm
FROM r""",
)
def customer_screening(spark, sf_dir):
    """One family of as many tests as there are customers: does what one orders cost differ from the mean?"""
    orders = table(spark, sf_dir, "orders")
    centred = orders.crossJoin(F.broadcast(orders.agg(F.avg("o_totalprice").alias("mean"))))  # one row
    each = centred.withColumn("d", F.col("o_totalprice") - F.col("mean")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).filter("n > 2 AND s > 0")
    p = association.two_sided_t(F.col("m") / (F.col("s") / F.sqrt("n")), F.col("n") - 1)
    return rounded(association.adjust(each.select("o_custkey", "n", p.alias("p")), "p", "o_custkey", []), 4)
