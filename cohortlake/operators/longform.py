"""Many columns at once: rows of (variable, value), so that one aggregate serves them all; and ranks and exact quantiles
without a window or a task that holds a whole column."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share. On one machine a temporary folder is taken where none is set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives lost executors. What was saved is not saved again."""
    if getattr(df, "_saved", False):
        return df
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._saved = True
    return out


def missing(column: str, df: DataFrame) -> F.Column:
    """Null, or not a number in a floating column."""
    kind = df.schema[column].dataType.typeName()
    return F.col(f"`{column}`").isNull() | F.isnan(f"`{column}`") if kind in ("double", "float") else F.col(f"`{column}`").isNull()


def correlation(x, y) -> F.Column:
    """Pearson's r of rows that have both, null if either is constant there."""
    both = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(both, F.lit(0.0))


def long(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """keep..., variable, value (double, null where missing)."""
    need(df, *columns, *keep)
    wide = df.select(*(f"`{c}`" for c in keep), *(F.when(~missing(c, df), F.col(f"`{c}`").cast("double")).alias(c) for c in columns))
    return wide.unpivot([F.col(f"`{c}`") for c in keep], [F.col(f"`{c}`") for c in columns], "variable", "value")


def value_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., value, c: the distinct values of each group and their rows, by partial aggregates."""
    return rows.filter("value IS NOT NULL").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))


def ranged(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds upto to (by..., value, c): the rows of the group up to and with this value.

    All values are dealt by ranges of (by, value), whatever the sizes of the groups; a window inside each range and one row a range give the running sum.
    """
    from cohortlake.operators.order import Ranges  # which uses ``saved``

    ranges = Ranges(counts, by, ["value"])
    return ranges.running(ranges.rows, upto=("sum", "c")).drop("_range")


#: So many distinct values of all groups together (some 200 MB, if one task had them all) go into one aggregate; more are cut into ranges.
FEW = 2_000_000


#: Bins of a group and level in which the places of quantiles are looked for, and such levels.
BINS, LEVELS = 4096, 5


def _around(counts: DataFrame, by: list[str], places) -> DataFrame:
    """Of (by..., value, c), saved, the values of the bins that hold one of ``places(n)`` (rows counted from 0; n are those of the group), with n and with upto, the
    rows of the group up to and with a value. Groups are cut into equal widths, and the bins that hold a place are cut again until ``FEW``
    values are left. What is cut is read and counted by bin, never sorted."""
    keys, inner = [*by, "_at"], counts.withColumn("_at", F.lit(0).cast("long"))
    same = lambda names: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in names])
    renamed = lambda d, names: d.select(*(F.col(k).alias(f"_k_{k}") for k in names), *(c for c in d.columns if c not in names))
    ends = saved(counts.groupBy(*by).agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.sum("c").alias("n")).withColumns({"_at": F.lit(0).cast("long"), "_below": F.lit(0).cast("long")}))
    for _ in range(LEVELS):
        span = F.col("_high") - F.col("_low")
        bin_ = F.when(span > 0, F.least(F.floor((F.col("value") - F.col("_low")) / span * BINS), F.lit(BINS - 1))).otherwise(0)
        placed = inner.join(F.broadcast(renamed(ends, keys)), same(keys)).withColumn("_at", F.col("_at") * BINS + bin_).select(*keys, "value", "c", "n", "_below", F.col("_k__at").alias("_from"))  # ends: some rows a group
        bins = placed.groupBy(*keys, "_from", "n", "_below").agg(F.sum("c").alias("_c"), F.min("value").alias("_low"), F.max("value").alias("_high"))
        before = Window.partitionBy(*by, "_from").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # over ``BINS`` rows
        bins = bins.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
        held = reduce(lambda a, b: a | b, [(F.col("_below") <= p) & (p < F.col("_below") + F.col("_c")) for p in places(F.col("n"))])
        ends = saved(bins.filter(held).select(*keys, "n", "_below", "_low", "_high"))
        inner = saved(placed.select(*keys, "value", "c").join(F.broadcast(renamed(ends.select(*keys), keys)), same(keys), "left_semi"))
        if inner.count() <= FEW:
            break
    kept = ranged(inner, keys)
    return kept.join(F.broadcast(renamed(ends.select(*keys, "n", "_below"), keys)), same(keys)).select(*by, "value", "c", "n", (F.col("upto") + F.col("_below")).alias("upto"))


def quantiles(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by..., and a column for each name of ``shares``: exact quantiles, interpolated between neighbours, from (by..., value, c).

    The counts are saved, so that what they come from is read once. Up to ``FEW`` of them one aggregate
    gives all quantiles; beyond, the bins that hold their places do, with the same results."""
    counts = saved(counts.select(*by, "value", "c"))
    if counts.count() <= FEW:
        q = counts.groupBy(*by).agg(F.percentile("value", list(shares.values()), F.col("c")).alias("_q"))
        return q.select(*by, *(F.col("_q")[i].alias(k) for i, k in enumerate(shares)))
    spots = lambda n: [f(F.lit(q) * (n - 1)) for q in shares.values() for f in (F.floor, F.ceil)]
    steps = _around(counts, by, spots)
    parts = []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("n") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            # the value that holds the place-th row, counted from 0
            parts.append(F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("value"))).alias(f"{name}_{side}"))
    out = steps.groupBy(*by, "n").agg(*parts)
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return out.select(*by, *((F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * part(q)).alias(k) for k, q in shares.items()))


def moments(df: DataFrame, columns: list[str], by: list[str] = (), median: bool = False) -> DataFrame:
    """by..., variable, n, mean, var (n - 1) and, if asked for, median of each column."""
    rows = long(df, columns, list(by)).filter("value IS NOT NULL")
    keys = [*by, "variable"]
    out = rows.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return out.join(quantiles(value_counts(rows, keys), keys, {"median": 0.5}), keys) if median else out


def ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, c, rank): each distinct value of a numeric column, its rows, and its average rank."""
    counts = value_counts(df.select(F.col(column).cast("double").alias("value")), [])
    return ranged(counts, []).select("value", "c", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def ranks_of(cells: DataFrame, value: str, count: str, name: str) -> DataFrame:
    """(value, name, name_t): average ranks, and rows, of the distinct values of a table of cells with counts."""
    counts = cells.groupBy(F.col(value).alias("value")).agg(F.sum(count).alias("c"))
    return ranged(counts, []).select(F.col("value").alias(value), (F.col("upto") - (F.col("c") - 1) / 2).alias(name), F.col("c").alias(f"{name}_t"))
