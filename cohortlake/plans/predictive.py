"""Predictive evaluation and comparison of selections over the standard tables; interaction for 0/1 outcomes. Not in SQL: tests/test_evaluation.py has dense versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import evaluation, features, inference
from cohortlake.plans.queries import query, rounded, table
from cohortlake.plans.tails import f_p

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a key and whether they were returned, which their price and quantity tell in part."""
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rows.withColumn("returned", ((F.col("l_quantity") + F.pmod(F.xxhash64("line"), F.lit(40))) > 45).cast("int"))


@query("split_rows", "SELECT l_returnflag, l_linestatus, count(*) AS n, true AS even FROM lineitem GROUP BY 1, 2")
def split_rows(spark, sf_dir):
    """Of each stratum its rows, and whether a fifth of them, within half a percent, is held out."""
    rows = returned(spark, sf_dir).withColumn("stratum", F.concat("l_returnflag", "l_linestatus"))
    s = evaluation.split(rows, "line", "stratum").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("held_out").cast("int")).alias("share"))
    return rounded(s.select("l_returnflag", "l_linestatus", "n", F.col("share").between(0.2, 0.205).alias("even")))


@query("predictive_evaluation")
def predictive_evaluation(spark, sf_dir):
    rows = evaluation.split(returned(spark, sf_dir), "line", "returned")
    one, other = evaluation.evaluate(rows, "returned", _COLUMNS), evaluation.evaluate(rows, "l_extendedprice", ["l_quantity", "l_linenumber"], "regression")
    out = [(task, name, float(v)) for task, found in (("classification", one), ("regression", other)) for name, v in found.items()]
    return rounded(spark.createDataFrame(out, "task string, measure string, value double"), 4)


@query("selection_comparison")
def selection_comparison(spark, sf_dir):
    return rounded(evaluation.compare(returned(spark, sf_dir), "line", "returned", _COLUMNS, size=3).drop("seconds"), 4)


@query("binary_interaction")
def binary_interaction(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("late", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(inference.binary_interaction(rows, "late", "l_linestatus", "l_suppkey"), 4)


_F = "SELECT '{c}' AS variable, pow(corr({c}, l_extendedprice), 2) AS r2, count(*) AS n FROM lineitem"


@query(
    "regression_selection",
    f"""
WITH r AS ({" UNION ALL ".join(_F.format(c=c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))}), f AS (SELECT *, r2 / (1 - r2) * (n - 2) AS f FROM r)
SELECT variable, round(f, 2) AS f, round({f_p("f", "1", "(n - 2)")}, 4) AS p, n, row_number() OVER (ORDER BY f DESC, variable) AS rank FROM f QUALIFY rank <= 3""",
)
def regression_selection(spark, sf_dir):
    out = features.univariate_regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], 3)
    return rounded(out.withColumn("f", F.round("f", 2)).withColumn("p", F.round("p", 4)))


_ETA = "(SELECT sum(n * pow(m - (SELECT avg({y}) FROM lineitem), 2)) / (SELECT var_pop({y}) * count(*) FROM lineitem) FROM (SELECT count(*) AS n, avg({y}) AS m FROM lineitem GROUP BY {g}))"


@query(
    "relevance_by_kind",
    f"""
WITH v AS (
    SELECT 'l_quantity' AS variable, abs(corr(l_quantity, l_extendedprice)) AS v, 'correlation' AS kind FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)), 'correlation' FROM lineitem
    UNION ALL SELECT 'l_returnflag', {_ETA.format(y="l_extendedprice", g="l_returnflag")}, 'eta2')
SELECT variable, round(v / max(v) OVER (), 6) AS relevance, kind FROM v""",
)
def relevance_by_kind(spark, sf_dir):
    return rounded(features.relevance_by_kind(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], ["l_returnflag"], True))
