"""Tables: reading, checks, previews, and the log of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlake.operators.guardrails import numeric_columns
from cohortlake.operators.longform import long, missing, quantiles, value_counts
from cohortlake.operators.order import Ranges


def load(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet, JSON-lines or CSV (with header) table. Without a ``schema`` a CSV is read once more to find its types: give one for large
    files."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path, schema) if schema else spark.read.json(path)
    if kind != "csv":
        raise ValueError(f"cannot read {kind}")
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def checked(df: DataFrame) -> DataFrame:
    """``df``; an error if it has no columns or no rows."""
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def preview(df: DataFrame, most: int = 30) -> DataFrame:
    """variable, kind, missing (percent), n, mean, sd, min, p25, median, p75, max of the first ``most`` columns; numbers only where there are any."""
    columns = df.columns[:most]
    kinds = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in columns], "variable string, kind string")
    gone = df.agg(*(F.struct(F.lit(c).alias("variable"), (100.0 * F.count_if(missing(c, df)) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("missing")).alias(f"c{i}") for i, c in enumerate(columns)))
    gone = gone.select(F.inline(F.array(*(f"c{i}" for i in range(len(columns))))))
    out = kinds.join(F.broadcast(gone), "variable")  # one row a column
    numbers = [c for c in numeric_columns(df) if c in columns]
    if not numbers:
        return out
    rows = long(df, numbers).filter("value IS NOT NULL")
    m = rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(value_counts(rows, ["variable"]), ["variable"], {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return out.join(m.join(q, "variable"), "variable", "left").select("variable", "kind", "missing", "n", "mean", "sd", "min", "p25", "median", "p75", "max")


def logged(calls: DataFrame, run: str, text: str, length: int = 2000) -> DataFrame:
    """Rows for the log of a run: run_id, the call's columns with ``text`` cut to ``length`` characters, and a SHA-256 of all of it."""
    return calls.select(F.lit(run).alias("run_id"), *(F.substring(text, 1, length).alias(text) if c == text else c for c in calls.columns), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))


def head(df: DataFrame, order: list[str], rows: int = 25, most: int = 30) -> DataFrame:
    """place (from 0), variable, value (as text, null where missing) of the first ``rows`` rows by ``order`` and the first ``most`` columns. ``order``
    should tell rows apart, as a table has no order of its own."""
    columns = df.columns[:most]
    top = df.orderBy(*order).limit(rows).select("*", (F.row_number().over(Window.orderBy(*order)) - 1).alias("_place"))  # ``rows`` rows
    return top.select(F.col("_place").alias("place"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot("place", columns, "variable", "value")


def aliased(calls: DataFrame, order: list[str], seed: int | None = None) -> DataFrame:
    """Adds alias, ``tool_log[i]`` with the call's place by ``order`` from 0, and seed. The calls are numbered by ranges, however many there are; where
    ``order`` does not tell them apart, equal ones are numbered in some order."""
    ranges = Ranges(calls.withColumn("_one", F.lit(1).cast("long")), [], order)
    numbered = ranges.running(ranges.rows, _n=("sum", "_one"))
    alias = F.concat(F.lit("tool_log["), (F.col("_n") - 1).cast("string"), F.lit("]"))
    return numbered.select(*calls.columns, alias.alias("alias"), F.lit(seed).cast("long").alias("seed"))


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a table of results, by run."""
    df.write.mode("append").partitionBy(*(["run_id"] if "run_id" in df.columns else [])).parquet(path)
