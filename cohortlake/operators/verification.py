"""Written claims against the data: which columns they speak of, which test they name, and what that test says when it is run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators import association as assoc
from cohortlake.operators import claims as claims_
from cohortlake.operators import inference, models, survival
from cohortlake.operators.guardrails import numeric_columns, tokens
from cohortlake.operators.longform import need
from cohortlake.operators.roles import levels


def aliases(df: DataFrame, known: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(alias, column), longest first: a column's name, the same in words, and what ``known`` adds."""
    out = {(c.lower(), c) for c in df.columns} | {(" ".join(tokens(c)), c) for c in df.columns} | {(a.lower(), c) for c, more in (known or {}).items() for a in more if c in df.columns}
    return sorted(out, key=lambda x: (-len(x[0]), x))


def resolved(claims: DataFrame, text: str, names: list[tuple[str, str]], but: list[str] = ()) -> DataFrame:
    """Adds variable and mentioned: the column of the longest alias that the text has as words, columns in ``but`` aside, and how many columns it
    mentions; variable is null if the longest aliases of several columns are equally long. The aliases are those of one table's columns."""
    need(claims, text)
    lower = F.lower(text)
    own = [(a, c) for a, c in names if c not in but]
    has = {(a, c): lower.rlike(rf"(?<![a-z0-9_]){re.escape(a)}(?![a-z0-9_])") for a, c in own}
    found = F.array_compact(F.array(*(F.when(has[a, c], F.struct(F.lit(len(a)).alias("n"), F.lit(c).alias("c"))) for a, c in own))) if own else F.array().cast("array<struct<n:int,c:string>>")
    out = claims.withColumn("_found", found)
    first = F.array_distinct(F.transform(F.filter("_found", lambda x: x["n"] == F.array_max(F.transform(F.col("_found"), lambda y: y["n"]))), lambda x: x["c"]))
    return out.withColumn("mentioned", F.size(F.array_distinct(F.transform("_found", lambda x: x["c"])))).withColumn("variable", F.when(F.size(first) == 1, first[0])).drop("_found")


def event_codes(df: DataFrame, event: str, codes: list | None = None, meanings: dict[str, str] | None = None, wanted: tuple[str, ...] = ("death", "dead", "died", "event")) -> list | None:
    """The values of ``event`` that count: given ones; 1 if all are 0 and 1; else those whose one meaning is a wanted word; None if that is unclear."""
    if codes:
        return list(codes)
    seen = [r[0] for r in df.select(F.expr(f"try_cast(`{event}` AS double)")).filter(F.col(event).isNotNull()).distinct().limit(20).collect()]
    if seen and set(seen) <= {0.0, 1.0}:
        return [1]
    found = [k for k, v in (meanings or {}).items() if set(tokens(v)) & set(wanted)]
    return [int(found[0])] if len(found) == 1 else None


def family_of(text, variable, numbers: list[str], flags: list[str], event: str | None, arm: str | None, time: str | None) -> F.Column:
    """The kind of test a claim speaks of, by its words and the kinds of its columns, the first that fits; else by its words alone, or null.

    Balance at baseline; correlation; Cox where hazards are named, or survival with a predictor; log-rank where it is named, or survival of
    arms; a predictor of the event by logistic regression if it is a number, by a table of counts if it is 0/1 or a category; a number that
    differs; a relationship."""
    says, lower = claims_.says, F.lower(text)
    some = variable.isNotNull() & (F.lit(event).isNull() | (variable != F.lit(event)))
    predicts = says(text, ["predict", "associated", "association"])
    number = variable.isin(numbers) if numbers else F.lit(False)
    flag = variable.isin(flags) if flags else F.lit(False)
    timed, armed = F.lit(bool(time and event)), F.lit(bool(arm and time and event))
    return (
        F.when(lower.contains("baseline") & says(text, ["balance", "smd"]), "baseline_balance")
        .when(lower.contains("correlat"), "correlation")
        .when(says(text, ["cox", "hazard"]), "cox_survival_predictor")
        .when(says(text, ["log-rank", "log rank", "kaplan"]), "kaplan_meier_logrank")
        .when(some & timed & predicts & lower.contains("survival"), "cox_survival_predictor")
        .when(armed & lower.contains("survival"), "kaplan_meier_logrank")
        .when(says(text, ["odds ratio", "logistic"]) & some & number & ~flag, "logistic_regression")
        .when(some & F.lit(event is not None) & (predicts | lower.contains("risk")), F.when(number & ~flag, "logistic_regression").otherwise("binary_categorical_association"))
        .when(some & number & says(text, ["difference", "differed", "higher", "lower", "increased", "decreased", "between"]), "continuous_group_difference")
        .when(some & ~number & lower.contains("relationship"), "binary_categorical_association")
        .otherwise(claims_.family(text))
    )


def tests(df: DataFrame, wanted: list[tuple[str, str]], event: str | None, arm: str | None, time: str | None) -> DataFrame:
    """family, variable, p, way (positive: higher with the event) of each distinct test that claims name, run once each: numeric variables against the
    event, or between two arms for balance, in one pass; categorical ones by chi-square, arms by log-rank, correlations with the event, predictors
    by logistic and Cox regression of their own. A regression that its data refuse gives no row."""
    schema, parts = "family string, variable string, p double, way string", []
    numbers = set(numeric_columns(df))
    sign = lambda c: F.when(F.col(c) > 0, "positive").when(F.col(c) < 0, "negative")
    screened = sorted({v for f, v in wanted if event and v in numbers and f in ("continuous_group_difference", "binary_categorical_association")})
    if screened:
        m = inference.screen(df, event, screened)
        for family in sorted({f for f, v in wanted if v in screened and f in ("continuous_group_difference", "binary_categorical_association")}):
            parts.append(m.filter(F.col("variable").isin([v for f, v in wanted if f == family])).select(F.lit(family).alias("family"), "variable", "p", sign("cohens_d").alias("way")))
    for family, v in wanted:
        if family == "binary_categorical_association" and event and v not in numbers:
            parts.append(assoc.chi_square(df, v, event).select(F.lit(family).alias("family"), F.lit(v).alias("variable"), "p", F.lit(None).cast("string").alias("way")))
        elif family == "kaplan_meier_logrank" and arm and event and time:
            parts.append(survival.log_rank(df, time, event, arm).select(F.lit(family).alias("family"), F.lit(v).alias("variable"), "p", F.lit(None).cast("string").alias("way")))
        elif family == "logistic_regression" and event and v in numbers:
            parts += _fitted(family, v, lambda v=v: models.logistic(df, event, [v]))
        elif family == "cox_survival_predictor" and event and time and v in numbers:
            parts += _fitted(family, v, lambda v=v: models.cox(df, time, event, [v]))
        elif family == "correlation" and event and v in numbers and v != event:
            parts.append(assoc.correlation_tests(df, [v, event]).select(F.lit(family).alias("family"), F.lit(v).alias("variable"), "p", sign("r").alias("way")))
    balanced = sorted({v for f, v in wanted if f == "baseline_balance" and v in numbers})
    if balanced and arm:
        arms = [r[0] for r in df.select(arm).filter(F.col(arm).isNotNull()).distinct().limit(3).collect()]
        if len(arms) == 2:
            m = inference.screen(df.withColumn("_second", (F.col(arm) == max(arms)).cast("int")), "_second", balanced)
            parts.append(m.select(F.lit("baseline_balance").alias("family"), "variable", "p", sign("cohens_d").alias("way")))
    out = df.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.union(part)
    return out


def _fitted(family: str, variable: str, fit) -> list[DataFrame]:
    """The row of a regression's term, or none if the data refuse it."""
    try:
        out = fit().filter(F.col("term") == variable)
    except ValueError:
        return []
    way = F.when(F.col("coef") > 0, "positive").when(F.col("coef") < 0, "negative")
    return [out.select(F.lit(family).alias("family"), F.lit(variable).alias("variable"), "p", way.alias("way"))]


def verify(claims: DataFrame, text: str, df: DataFrame, event: str | None = None, arm: str | None = None, time: str | None = None, known: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds family, variable, p, way and verdict to ``claims`` (with p_operator and p_value as ``evidence.reported`` reads them). Claims collapse to
    distinct tests, at most families times columns; each runs once and is joined back."""
    rows = resolved(claims, text, aliases(df, known), [c for c in (event, time) if c])
    flags = [c for c, (_, flag) in levels(df).items() if flag]
    rows = rows.withColumn("family", family_of(F.col(text), F.col("variable"), numeric_columns(df), flags, event, arm, time))
    rows = rows.withColumn("variable", F.when(F.col("family") == "kaplan_meier_logrank", F.lit(arm)).otherwise(F.col("variable")))
    rows = rows.withColumn("significant", claims_.significant(F.col(text), F.col("p_operator"), F.col("p_value")))
    wanted = [(r.family, r.variable) for r in rows.select("family", "variable").dropna().distinct().orderBy("family", "variable").collect()]
    found = tests(df, wanted, event, arm, time).withColumnRenamed("family", "_f").withColumnRenamed("variable", "_v")
    out = rows.join(F.broadcast(found), (F.col("family") == F.col("_f")) & (F.col("variable") == F.col("_v")), "left").drop("_f", "_v")  # families times columns
    return claims_.verdict(out, text, "p", "way")
