"""Findings: which test, endpoint types, corrections and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators import association as assoc
from cohortlake.operators import inference
from cohortlake.operators.longform import need

# Names that are an outcome or a follow-up time themselves.
OUTCOME_NAMES = ["deathevent", "death", "mortality", "status", "event", "outcome", "survival", "survived"]
FOLLOW_UP_NAMES = ["time", "followup", "followuptime", "days", "followupdays", "survivaltime"]


def compare_groups(df: DataFrame, value: str, group: str, a, b, alpha: float = 0.05) -> DataFrame:
    """test, n_a, n_b, dropped, statistic, effect, p, significant: Welch's t if both groups have 30 values or both, being smaller, pass
    Shapiro-Wilk; else Mann-Whitney, exact for groups of 8 at most without ties. Two values a group are needed."""
    need(df, value, group)
    rows = df.filter(F.col(group).cast("string").isin(str(a), str(b))).select((F.col(group).cast("string") == str(a)).alias("g"), F.col(value).cast("double").alias("v"))
    s = rows.agg(F.count(F.when(F.col("g"), F.col("v"))).alias("na"), F.count(F.when(~F.col("g"), F.col("v"))).alias("nb"), F.count_if(F.col("v").isNull()).alias("dropped")).first()
    if min(s.na, s.nb) < 2:
        raise ValueError("two values a group are needed")
    normal = min(s.na, s.nb) >= 30
    if not normal:
        wide = rows.select(F.when(F.col("g"), F.col("v")).alias("a"), F.when(~F.col("g"), F.col("v")).alias("b"))
        tests = inference.normality(wide, ["a", "b"]).collect()  # two rows
        normal = all(t.p is not None and t.p > 0.05 for t in tests)
    if normal:
        out = assoc.welch(rows, "v", "g", True, False).select(F.lit("welch").alias("test"), "n_a", "n_b", F.col("t").alias("statistic"), F.col("cohens_d").alias("effect"), "p")
    else:
        out = assoc.mann_whitney(rows, "v", "g", True, False).select(F.lit("mann_whitney").alias("test"), "n_a", "n_b", F.col("u").alias("statistic"), F.col("cliffs_delta").alias("effect"), "p")
        if max(s.na, s.nb) <= 8 and rows.select("v").dropna().distinct().count() == s.na + s.nb:
            out = out.withColumn("p", F.lit(assoc.exact_mann_whitney_p(out.first().statistic, s.na, s.nb)))
    return out.withColumn("dropped", F.lit(s.dropped)).withColumn("significant", F.col("p") < alpha)


def endpoint_types(findings: DataFrame, key: str, primary: list) -> DataFrame:
    """Adds endpoint_type: primary for the listed keys, else secondary."""
    return findings.withColumn("endpoint_type", F.when(F.col(key).isin(primary) if primary else F.lit(False), "primary").otherwise("secondary"))


def corrected(findings: DataFrame, key: str, p: str, study: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds adjusted (Bonferroni over the primary endpoints of a study, Benjamini-Hochberg over its secondary ones if any primary one is
    below ``alpha``, else null), gated_out and significant. Rows need endpoint_type; those without p take no part."""
    rows = findings.filter(F.col(p).isNotNull()).withColumn("_primary", F.col("endpoint_type") == "primary")
    out = assoc.gate(rows, p, key, "_primary", study, alpha).drop("_primary")
    return out.withColumn("significant", F.coalesce(F.col("adjusted") < alpha, F.lit(False)))
