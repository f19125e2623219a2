"""Guardrails and preparation: column roles, plausible ranges and units, repeated measures, encodings, samples, plot data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.longform import long, missing, need, quantiles, saved, value_counts

# A name's word, its least and greatest plausible value, and the unit.
RANGES = [
    ("age", 0, 130, "years"), ("bili", 0, 100, "mg/dL"), ("albumin", 0.5, 8, "g/dL"), ("protime", 5, 60, "seconds"), ("platelet", 10, 1500, "×10³/μL"),
    ("ast", 0, 5000, "U/L"), ("alt", 0, 5000, "U/L"), ("alk_phos", 0, 15000, "U/L"), ("alkaline", 0, 15000, "U/L"), ("copper", 0, 2000, "μg/day"),
    ("trig", 0, 3000, "mg/dL"), ("chol", 0, 1500, "mg/dL"), ("cholesterol", 0, 1500, "mg/dL"), ("hemoglobin", 1, 25, "g/dL"), ("hgb", 1, 25, "g/dL"),
    ("creatinine", 0, 30, "mg/dL"), ("glucose", 0, 2000, "mg/dL"), ("sodium", 100, 180, "mEq/L"), ("potassium", 1, 10, "mEq/L"), ("bmi", 5, 80, "kg/m²"),
    ("weight", 1, 400, "kg"), ("height", 30, 250, "cm"), ("sbp", 40, 250, "mmHg"), ("dbp", 20, 180, "mmHg"), ("hr", 20, 300, "bpm"), ("pulse", 20, 300, "bpm"),
]
# A name's word and the range its median is expected in.
MEDIANS = [
    ("age", 1, 100), ("bili", 0, 50), ("albumin", 1, 6), ("protime", 8, 40), ("platelet", 10, 1200), ("chol", 0.5, 600), ("cholesterol", 0.5, 600),
    ("hemoglobin", 5, 22), ("hgb", 5, 22), ("creatinine", 0, 15), ("weight", 2, 300), ("height", 50, 220), ("bmi", 10, 60),
]
# Words that name a treatment column.
ARM_WORDS = "treatment treat arm group grp intervention control allocation randomized randomised trt".split()
# The forms in which a text counts as a date.
DATES = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]
NUMERIC = ("double", "float", "integer", "long", "short", "byte", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName().split("(")[0] in NUMERIC]


def tokens(name: str) -> list[str]:
    """The words of a column's name: runs of letters or digits, in lower case."""
    return re.findall(r"[a-z]+|[0-9]+", name.lower())


def rule_for(column: str, rules: list[tuple]) -> tuple | None:
    """The first rule whose words are among the name's words, one after the other."""
    own = tokens(column)

    def holds(words: list[str]) -> bool:
        return any(own[i : i + len(words)] == words for i in range(len(own) - len(words) + 1))

    return next((r for r in rules if holds(tokens(r[0]))), None)


def range_violations(df: DataFrame) -> DataFrame:
    """variable, low, high, unit, n, outside, percent, severity (high above 10 %, medium above 2 %) of every numeric column
    whose name has a plausible range and which leaves it."""
    rules = [(c, float(r[1]), float(r[2]), r[3]) for c in numeric_columns(df) if (r := rule_for(c, RANGES))]
    table = df.sparkSession.createDataFrame(rules, "variable string, low double, high double, unit string")
    if not rules:
        return table.selectExpr("*", "0L AS n", "0L AS outside", "0D AS percent", "'' AS severity")
    rows = long(df, [r[0] for r in rules]).filter("value IS NOT NULL").join(F.broadcast(table), "variable")  # one rule a column
    out = rows.groupBy("variable", "low", "high", "unit").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outside")).filter("outside > 0")
    percent = F.round(100 * F.col("outside") / F.col("n"), 1)
    return out.withColumn("percent", percent).withColumn("severity", F.when(F.col("percent") > 10, "high").when(F.col("percent") > 2, "medium").otherwise("low"))


def range_examples(df: DataFrame, key: str, most: int = 5) -> DataFrame:
    """variable, place (from 1), key, value: of every column that leaves its plausible range the first ``most`` values outside, by ``key``.

    Null values and NaN are not looked at; of rows with one key the smaller values come first. A task passes on no more than ``most`` rows a column.
    """
    rules = [(c, float(r[1]), float(r[2])) for c in numeric_columns(df) if c != key and (r := rule_for(c, RANGES))]
    kind = df.schema[key].dataType.simpleString()
    if not rules:
        return df.sparkSession.createDataFrame([], f"variable string, place int, key {kind}, value double")
    table = df.sparkSession.createDataFrame(rules, "variable string, low double, high double")
    rows = df.select(F.col(key).alias("_key"), *(F.col(c).cast("double").alias(c) for c, *_ in rules)).unpivot("_key", [c for c, *_ in rules], "variable", "value")
    rows = rows.filter("NOT isnan(value)").join(F.broadcast(table), "variable").filter((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))  # one rule a column
    place = F.row_number().over(Window.partitionBy("variable").orderBy("_key", "value"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("variable", "place", F.col("_key").alias("key"), "value")


def bar(df: DataFrame, x: str, most: int = 30) -> DataFrame:
    """place (from 1), level, n: the ``most`` most frequent values of ``x``, equal ones by name; nulls are left out."""
    top = df.filter(~missing(x, df)).select(F.col(x).cast("string").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level").limit(most)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "level")).alias("place"), "level", "n")  # ``most`` rows


def heat_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every ordered pair of ``columns``: Pearson's r of the rows that have both, 1 on the diagonal; null where a column is constant."""
    # imported here, as association imports this module
    from cohortlake.operators.association import correlations

    r = correlations(df, columns).select("a", "b", F.when(~F.isnan("r"), F.col("r")).alias("r"))
    own = df.agg(*(F.var_samp(F.col(c).cast("double")).alias(c) for c in columns)).unpivot([], columns, "a", "v")
    return r.union(r.select("b", "a", "r")).union(own.select("a", F.col("a").alias("b"), F.when(F.col("v") > 0, 1.0).alias("r")))


def implausible_units(df: DataFrame) -> DataFrame:
    """variable, low, high, median of columns (3 values at least) whose median leaves the range expected of the name."""
    rules = [(c, float(r[1]), float(r[2])) for c in numeric_columns(df) if (r := rule_for(c, MEDIANS))]
    table = df.sparkSession.createDataFrame(rules, "variable string, low double, high double")
    if not rules:
        return table.selectExpr("*", "0D AS median")
    counts = value_counts(long(df, [r[0] for r in rules]), ["variable"])
    enough = counts.groupBy("variable").agg(F.sum("c").alias("n")).filter("n >= 3").select("variable")
    m = quantiles(counts, ["variable"], {"median": 0.5}).join(enough, "variable")
    return m.join(F.broadcast(table), "variable").filter("median < low OR median > high").select("variable", "low", "high", "median")


def low_cardinality(df: DataFrame, keys: list[str] = (), most: int = 6) -> DataFrame:
    """variable, levels of numeric columns with 2 to ``most`` whole values: categories in the guise of numbers."""
    columns = [c for c in numeric_columns(df) if c not in keys]
    rows = long(df, columns).filter("value IS NOT NULL").groupBy("variable").agg(F.count_distinct("value").alias("levels"), F.every(F.col("value") == F.floor("value")).alias("whole"))
    return rows.filter((F.col("levels") >= 2) & (F.col("levels") <= most) & F.col("whole")).select("variable", "levels")


def repeated_measures(df: DataFrame, key: str) -> DataFrame:
    """subjects, repeating, most, longitudinal: three rows of one subject, or more than half of all subjects repeating."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    out = counts.agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("c") > 1).alias("repeating"), F.max("c").alias("most"))
    return out.withColumn("longitudinal", (F.col("most") >= 3) | (F.col("repeating") > 0.5 * F.col("subjects")))


def treatment_columns(df: DataFrame) -> DataFrame:
    """variable, levels, top_share of columns named like a treatment with 2 to 5 levels, none above 60 % of all rows."""
    named = [c for c in df.columns if set(tokens(c)) & set(ARM_WORDS)]
    if not named:
        return df.sparkSession.createDataFrame([], "variable string, levels long, top_share double")
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in named)).unpivot([], named, "variable", "value")
    counts = rows.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy("variable").agg(F.count("value").alias("levels"), (F.max(F.when(F.col("value").isNotNull(), F.col("c"))) / F.sum("c")).alias("top_share"))
    return out.filter("levels BETWEEN 2 AND 5 AND top_share <= 0.6")


def overview(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, n_numeric, complete: rows without a missing value."""
    whole = sum((missing(c, df).cast("int") for c in df.columns), F.lit(0)) == 0
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(whole).alias("complete")).withColumn("n_columns", F.lit(len(df.columns))).withColumn("n_numeric", F.lit(len(numeric_columns(df))))


def coercions(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """variable, suggestion, rate. Text: numeric if above 90 % of the values are numbers, date if above 80 % are whole dates of one of DATES.
    Numbers: boolean if a floating column holds 0 and 1 only; whole if all its values are whole and more than 80 % of the rows and more than 50
    are distinct; category if an integer column has 8 values at most and fewer than 5 % of its rows, 3 at least."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in keys]
    numbers = [c for c in numeric_columns(df) if c not in keys]
    floats = [c for c in numbers if df.schema[c].dataType.typeName() in ("double", "float")]
    parts = []
    if texts:
        rows = df.select(*(f"`{c}`" for c in texts)).unpivot([], [F.col(f"`{c}`") for c in texts], "variable", "value").filter("value IS NOT NULL").groupBy("variable")
        day = F.coalesce(*(F.try_to_timestamp(F.col("value"), F.lit(d)) for d in DATES)).isNotNull()
        rates = rows.agg(F.avg(F.expr("try_cast(value AS double)").isNotNull().cast("int")).alias("number"), F.avg(day.cast("int")).alias("day"))
        parts.append(rates.select("variable", F.when(F.col("number") > 0.9, "numeric").when(F.col("day") > 0.8, "date").alias("suggestion"), F.when(F.col("number") > 0.9, F.col("number")).otherwise(F.col("day")).alias("rate")))
    if numbers:
        counts = value_counts(long(df, numbers), ["variable"])
        m = counts.groupBy("variable").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.every(F.col("value").isin(0.0, 1.0)).alias("flags"), F.every(F.col("value") == F.floor("value")).alias("whole"))
        floating = F.col("variable").isin(floats) if floats else F.lit(False)
        kind = F.when(floating & F.col("flags"), "boolean").when(floating & F.col("whole") & (F.col("d") > F.greatest(0.8 * F.col("n"), F.lit(50))), "whole")
        kind = kind.when(~floating & (F.col("d") <= 8) & (F.col("d") < F.greatest(0.05 * F.col("n"), F.lit(3))), "category")
        parts.append(m.select("variable", kind.alias("suggestion"), (F.col("d") / F.col("n")).alias("rate")))
    if not parts:
        return df.sparkSession.createDataFrame([], "variable string, suggestion string, rate double")
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out.filter("suggestion IS NOT NULL")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Adds ``column``_code: levels numbered from 0 in order, -1 for null. Levels are numbered by ranges of their order, so that no task
    holds all of them."""
    levels = df.select(F.col(column)).filter(F.col(column).isNotNull()).distinct()
    ordered = levels.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    ordered = saved(ordered)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(column)
    codes = ordered.join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.row_number().over(inside) - 1).cast("int").alias(f"{column}_code"))
    return df.join(codes, column, "left").fillna(-1, [f"{column}_code"])


def prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as numbers: text is encoded by ``label_encode``, a missing number becomes the column's median."""
    need(df, *columns)
    numbers = [c for c in columns if c in numeric_columns(df)]
    out = df
    for c in (c for c in columns if c not in numbers):
        out = label_encode(out, c).drop(c).withColumnRenamed(f"{c}_code", c)
    if numbers:
        m = {r.variable: r["median"] for r in quantiles(value_counts(long(df, numbers), ["variable"]), ["variable"], {"median": 0.5}).collect()}  # one row a column
        out = out.withColumns({c: F.when(missing(c, df), F.lit(m.get(c))).otherwise(F.col(c)).cast("double") for c in numbers})
    return out


def dummies(df: DataFrame, column: str, most: int = 200) -> DataFrame:
    """Adds a 0/1 column for every level but the first in order; null where the column is null."""
    levels = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError("too many levels")
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in levels[1:]})


def stratified_sample(df: DataFrame, key: str, stratum: str, size: int) -> DataFrame:
    """About ``size`` rows: of each stratum its share, one at least, lowest hashes of the key first, so reruns agree."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    quota = counts.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.round(size * F.col("_c") / F.col("_t")).cast("int")).alias("_q"))  # total is one row
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key))).filter(F.col("_r") <= size)
    return ranked.join(quota, ranked[stratum].eqNullSafe(quota[stratum])).filter("_r <= _q").drop(quota[stratum]).drop("_r", "_q")


def sample_rows(df: DataFrame, key: str, n: int = 20, column: str | None = None, equal: str | None = None) -> DataFrame:
    """The n rows with the lowest md5 of their key, the same however the table is partitioned, with matching: the number of all rows whose
    ``column``, if given, reads ``equal``."""
    rows = df if column is None else equals(df, column, equal)
    total = rows.agg(F.count(F.lit(1)).alias("matching"))
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n).crossJoin(F.broadcast(total))  # one row


def equals(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows whose ``column`` reads ``value``; a whole number in a floating column reads with and without its .0."""
    need(df, column)
    text = F.col(column).cast("string")
    return df.filter((text == value) | (F.regexp_replace(text, r"\.0$", "") == value))


def boxplot(df: DataFrame, column: str, group: str) -> DataFrame:
    """group, n, q1, median, q3, low and high whiskers (extremes within 1.5 interquartile ranges) and rows beyond them."""
    rows = df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("v")).dropna()
    q = quantiles(value_counts(rows.withColumnRenamed("v", "value"), ["g"]), ["g"], {"a": 0.25, "b": 0.5, "c": 0.75}).select("g", F.array("a", "b", "c").alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = (F.col("v") >= F.col("q")[0] - reach) & (F.col("v") <= F.col("q")[2] + reach)
    out = rows.join(q, "g").groupBy("g", "q").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("beyond"))
    return out.select(F.col("g").alias(group), "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high", "beyond")


def density(df: DataFrame, column: str, points: int = 100, bins: int = 0) -> DataFrame:
    """point, x, density: a Gaussian kernel (Scott's bandwidth) on a grid. Values are first counted in ``bins`` equal bins and stand at the
    middle of theirs, so that the kernel is summed over bins by points, whatever the rows; without bins over all distinct values."""
    need(df, column)
    rows = long(df, [column]).filter("value IS NOT NULL")
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), F.var_samp("value").alias("v"))
    n = F.col("n").cast("double")
    s = ends.withColumn("h", F.sqrt("v") * F.pow(n, F.lit(-0.2))).filter("h > 0")
    if bins:
        wide = (F.col("b") - F.col("a")) / bins
        rows = rows.crossJoin(F.broadcast(s)).select((F.col("a") + wide * (F.least(F.floor((F.col("value") - F.col("a")) / wide), F.lit(bins - 1)) + 0.5)).alias("value"))  # one row
    counts = saved(rows.groupBy("value").agg(F.count(F.lit(1)).alias("c")))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = counts.crossJoin(F.broadcast(s)).withColumn("point", at).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("point") / (points - 1))  # s is one row
    kernel = F.exp(-(((F.col("x") - F.col("value")) / F.col("h")) ** 2) / 2)
    return grid.groupBy("point", "x").agg((F.sum(F.col("c") * kernel) / (F.max(n * F.col("h")) * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def findings(df: DataFrame, key: str | None = None) -> DataFrame:
    """check_type, variable, severity, detail: what the checks above find, in one table."""
    found = [
        range_violations(df).select(F.lit("range_violation").alias("check_type"), "variable", "severity", F.format_string("%d of %d values outside %s to %s %s", "outside", "n", F.col("low").cast("string"), F.col("high").cast("string"), "unit").alias("detail")),
        implausible_units(df).select(F.lit("unit_plausibility"), "variable", F.lit("medium"), F.format_string("median outside %s to %s", F.col("low").cast("string"), F.col("high").cast("string"))),
        low_cardinality(df, [key] if key else []).select(F.lit("low_cardinality_numeric"), "variable", F.lit("low"), F.format_string("%d levels", "levels")),
    ]
    if key:
        found.append(repeated_measures(df, key).filter("most > 1").select(F.lit("repeated_measures"), F.lit(key), F.when(F.col("longitudinal"), "medium").otherwise("low"), F.format_string("%d of %d subjects repeat", "repeating", "subjects")))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def finding_summary(df: DataFrame, key: str | None = None) -> DataFrame:
    """check_type, severity, n of ``findings``."""
    return findings(df, key).groupBy("check_type", "severity").agg(F.count(F.lit(1)).alias("n"))


def scatter(df: DataFrame, key: str, x: str, y: str, most: int = 500) -> DataFrame:
    """key, x, y of ``most`` complete rows at most, those of the lowest md5 of their key, so that reruns agree."""
    need(df, key, x, y)
    rows = df.filter(~missing(x, df) & ~missing(y, df)).select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(most)


def grouped_histogram(df: DataFrame, column: str, group: str, bins: int = 20) -> DataFrame:
    """group, bin (from 1), low, count: equal-width bins over the whole column, the last closed, counted by group; empty ones are left out."""
    rows = long(df, [column], [group]).filter("value IS NOT NULL")
    ends = rows.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    half = F.when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
    ends = F.broadcast(ends.select((F.col("a") - half).alias("a"), (F.col("b") + half).alias("b")))  # one row
    width = (F.col("b") - F.col("a")) / bins
    counts = rows.crossJoin(ends).groupBy(F.col(group).alias("group"), F.least(F.floor((F.col("value") - F.col("a")) / width) + 1, F.lit(bins)).alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("group", "bin", (F.col("a") + (F.col("bin") - 1) * width).alias("low"), "count")
