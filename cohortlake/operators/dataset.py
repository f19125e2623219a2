"""What stands out in a table, as rows to cite: missing values, repeated keys, constants, far values, strong correlations, small categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators import association as assoc
from cohortlake.operators import profile
from cohortlake.operators.guardrails import numeric_columns, tokens
from cohortlake.operators.longform import missing
from cohortlake.operators.roles import missingness_of


def evidence(df: DataFrame, key: str, top: int = 10, levels: int = 20) -> DataFrame:
    """kind, place (from 0 within the kind), subject, value, citation: percent missing of the columns that miss any; rows that repeat an identifier (columns
    named like one); constant columns; the 3 farthest values of each column beyond its fences; the ``top`` strongest correlations; the shares of text
    columns of ``levels`` values at most."""
    numbers = [c for c in numeric_columns(df) if c != key and "id" not in tokens(c)]
    texts = [c for c, k in df.dtypes if k == "string"]
    ids = [c for c in df.columns if c == key or "id" in tokens(c)]
    row = lambda d, kind, subject, value: d.select(F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"))
    parts = [row(missingness_of(df).filter("missing > 0"), "missing", F.col("variable"), F.col("percent"))]
    for c in ids:
        parts.append(row(profile.duplicates(df.filter(F.col(c).isNotNull()), [c]).filter("rows > 0"), "repeated_id", F.lit(c), F.col("rows")))
    if numbers:
        s = profile.column_statistics(df, numbers)
        parts.append(row(s.filter(F.col("distinct") == 1), "constant", F.col("variable"), F.col("min")))
        parts.append(row(profile.outlier_examples(df, key, numbers, top=3), "outlier", F.concat(F.col("variable"), F.lit("@"), F.col("key").cast("string")), F.col("value")))
    if len(numbers) > 1:
        r = assoc.correlations(df, numbers).filter("r IS NOT NULL AND NOT isnan(r)").withColumn("size", F.abs("r")).orderBy(F.desc("size"), "a", "b").limit(top)
        parts.append(row(r, "top_correlations", F.concat(F.lit("("), F.col("a"), F.lit(", "), F.col("b"), F.lit(")")), F.col("r")))
    if texts:
        counts = df.select(*texts).unpivot([], texts, "variable", "level").filter("level IS NOT NULL").groupBy("variable", "level").agg(F.count(F.lit(1)).alias("c"))
        whole = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("n")).filter(F.col("d") <= levels)
        parts.append(row(counts.join(F.broadcast(whole), "variable"), "share", F.concat_ws("=", "variable", "level"), F.col("c") / F.col("n")))  # one row a column
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    at = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.abs("value")), "subject")) - 1  # few rows of each kind
    out = out.withColumn("place", at)
    return out.withColumn("citation", F.concat(F.col("kind"), F.lit("["), F.col("place").cast("string"), F.lit("]: "), F.col("subject"), F.lit("="), F.format_number("value", 4)))


def cardinality(df: DataFrame) -> DataFrame:
    """variable, distinct, place (from 0, most values first, equal ones by name), citation: the exact number of different values, nulls and NaN apart, of every
    column. Values are compared as text, but for zeros of either sign, which are one value."""
    kinds = dict(df.dtypes)
    text = lambda c: ((F.col(f"`{c}`") + F.lit(0).cast(kinds[c])) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).cast("string")
    levels = df.select(*(F.when(~missing(c, df), text(c)).alias(c) for c in df.columns)).unpivot([], [f"`{c}`" for c in df.columns], "variable", "level").groupBy("variable", "level").agg(F.lit(1).alias("one"))
    out = levels.groupBy("variable").agg(F.count("level").alias("distinct"))
    out = out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("distinct"), "variable")) - 1)  # one row a column
    return out.withColumn("citation", F.concat(F.lit("cardinality["), F.col("place").cast("string"), F.lit("]: "), F.col("variable"), F.lit("="), F.col("distinct").cast("string")))
