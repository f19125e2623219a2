"""Survival: rows collapse to distinct times, which running sums over ranges put in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.operators.order import Ranges


def _at_risk(df: DataFrame, time: str, event: str, group: str) -> tuple[Ranges, DataFrame]:
    """Ranges of the distinct positive times of every group, and their rows (g, t, d, c, n): n is a sum over this time and all later ones."""
    rows = df.filter(F.col(time) > 0).groupBy(F.col(group).alias("g"), F.col(time).cast("double").alias("t")).agg(F.sum(F.coalesce(F.col(event).cast("int"), F.lit(0))).alias("d"), F.count(F.lit(1)).alias("c"))
    ranges = Ranges(rows, ["g"], ["t"])
    return ranges, ranges.running(ranges.rows, reverse=True, n=("sum", "c"))


def risk_table(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """g, t, d (events), n (at risk) for every distinct positive time of every group; a null event counts as none."""
    return _at_risk(df, time, event, group)[1].select("g", "t", "d", "n")


def kaplan_meier(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """g, t, d, n, survival after each time with an event: the product of the shares that survive each time up to it."""
    ranges, table = _at_risk(df, time, event, group)
    curve = ranges.running(table.filter("d > 0"), survival=("product", 1 - F.col("d") / F.col("n")))
    return curve.select("g", "t", "d", "n", "survival")


def median_survival(curve: DataFrame) -> DataFrame:
    """g, median: the first time at which half or fewer survive, null if none."""
    return curve.groupBy("g").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def log_rank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """groups, chi2, df, p of equal survival in all groups, from observed less expected events of each group and their covariances.

    A group's number at risk at a time is what it has left, so a group counts at the times of its own rows and what lies between
    is filled from the last of them: times with events meet groups, which are few, and rows are never compared.
    """
    rows = df.filter(F.col(time) > 0).select(F.col(group).cast("string").alias("g"), F.col(time).cast("double").alias("t"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("e")).dropna()
    each = rows.groupBy("g", "t").agg(F.sum("e").alias("d"), F.count(F.lit(1)).alias("c"))
    names = sorted(r.g for r in each.select("g").distinct().limit(201).collect())  # a row a group, 201 at most
    k = len(names)
    if k > 200:
        raise ValueError("more than 200 groups: their covariances are one matrix")
    if k < 2:
        return df.sparkSession.createDataFrame([(k, None, None, None)], "groups long, chi2 double, df long, p double")
    wide = each.groupBy("t").agg(*(F.sum(F.when(F.col("g") == g, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i, g in enumerate(names) for c in "dc"))
    ranges = Ranges(wide, [], ["t"])
    at = ranges.running(ranges.rows, reverse=True, **{f"n{i}": ("sum", f"c{i}") for i in range(k)})
    nt, dt = sum((F.col(f"n{i}") for i in range(k)), F.lit(0)), sum((F.col(f"d{i}") for i in range(k)), F.lit(0))
    at = at.withColumn("nt", nt).withColumn("dt", dt).filter("dt > 0")
    spread = F.when(F.col("nt") > 1, F.col("dt") * (F.col("nt") - F.col("dt")) / (F.col("nt") - 1)).otherwise(0.0)
    share = [F.col(f"n{i}") / F.col("nt") for i in range(k)]
    s = at.agg(*(F.sum(F.col(f"d{i}") - F.col("dt") * share[i]).alias(f"u{i}") for i in range(k)), *(F.sum(spread * ((share[i] if i == j else F.lit(0.0)) - share[i] * share[j])).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k))).first()
    u = np.array([s[f"u{i}"] or 0.0 for i in range(k - 1)])
    v = np.array([[s[f"v{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k - 1)] for i in range(k - 1)])
    chi2 = float(u @ np.linalg.pinv(v) @ u)
    return df.sparkSession.createDataFrame([(k, chi2, k - 1, dist.chi2_sf(chi2, k - 1))], "groups long, chi2 double, df long, p double")


def events(df: DataFrame, event: str, codes: list | None = None) -> F.Column:
    """1 for a row whose ``event`` is among ``codes``; without codes its number, 0 for null or no number."""
    return F.col(event).isin(codes).cast("int") if codes else F.coalesce(F.expr(f"try_cast(`{event}` AS double)"), F.lit(0.0)).cast("int")


def accounting(df: DataFrame, time: str, event: str, codes: list | None = None) -> DataFrame:
    """rows, no_time (not positive or no number), n, events, censored, rate."""
    t, e = F.expr(f"try_cast(`{time}` AS double)"), events(df, event, codes)
    ok = F.coalesce(t > 0, F.lit(False))
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("no_time"), F.count_if(ok).alias("n"), F.count_if(ok & (F.coalesce(e, F.lit(0)) == 1)).alias("events"))
    return out.withColumn("censored", F.col("n") - F.col("events")).withColumn("rate", F.col("events") / F.nullif("n", F.lit(0)))


def summary(df: DataFrame, time: str, event: str, group: str, times: list[float] = (365, 730, 1095, 1825)) -> DataFrame:
    """g, n, events, censored, rate, median (null if never reached), and survival at each of ``times``."""
    rows = df.filter(F.col(time) > 0).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(event).cast("int"), F.lit(0))).alias("events"))
    curve = kaplan_meier(df, time, event, group)
    at = curve.groupBy("g").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"), *(F.max_by("survival", F.when(F.col("t") <= x, F.col("t"))).alias(f"_s{i}") for i, x in enumerate(times)), *(F.min("t").alias("_first") for _ in range(1)))
    out = rows.join(at, "g", "left")
    shown = [F.when(F.coalesce(F.col("_first") <= x, F.lit(False)), F.col(f"_s{i}")).otherwise(1.0).alias(f"survival_{x:g}") for i, x in enumerate(times)]
    return out.select("g", "n", "events", (F.col("n") - F.col("events")).alias("censored"), (F.col("events") / F.col("n")).alias("rate"), "median", *shown)
