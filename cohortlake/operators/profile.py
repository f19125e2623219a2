"""Profiles of a table: counts, summaries, distributions, missingness, duplicates, outliers, digits, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.columns import chi_square_sf
from cohortlake.operators.longform import correlation, long, missing, moments, need, quantiles, saved, value_counts as counted


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """value, count, share of the ``top`` most frequent non-null values, ties by value."""
    need(df, column)
    counts = df.filter(~missing(column, df)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.orderBy(F.desc("count"), "value").limit(top).crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total")).alias("share"))


def group_summary(df: DataFrame, groups: list[str], targets: list[str]) -> DataFrame:
    """Mean, median, count and standard deviation of each target in each group without null keys."""
    need(df, *groups, *targets)
    for g in groups:
        df = df.filter(F.col(g).isNotNull())
    aggs = [f(c).alias(f"{c}_{name}") for c in targets for name, f in (("mean", F.avg), ("count", F.count), ("std", F.stddev_samp))]
    keys = [*groups, "variable"]
    medians = quantiles(counted(long(df, targets, groups), keys), keys, {"median": 0.5})
    medians = medians.groupBy(*groups).agg(*(F.max(F.when(F.col("variable") == c, F.col("median"))).alias(f"{c}_median") for c in targets))
    out = df.groupBy(*groups).agg(*aggs)
    same = [out[g] == medians[g] for g in groups]
    return out.join(medians, same, "left").select(*(out[g] for g in groups), *(f"{c}_{k}" for c in targets for k in ("mean", "median", "count", "std")))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a numeric column: counts, moments (skewness and kurtosis bias-corrected), exact quantiles, zeros. Columns
    collapse to the counts of their distinct values first, which everything else is taken from."""
    rows = long(df, columns)
    nulls = rows.groupBy("variable").agg(F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"))
    counts = saved(counted(rows, ["variable"]))
    c, off = F.col("c"), F.col("value") - F.col("mean")
    m = counts.join(F.broadcast(nulls), "variable", "right").groupBy("variable", "nulls", "mean").agg(  # nulls: one row a column of the table
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("value").alias("distinct"), F.min("value").alias("min"), F.max("value").alias("max"),
        *(F.sum(c * off**k).alias(f"s{k}") for k in (2, 3, 4)), F.coalesce(F.sum(F.when(F.col("value") == 0, c)), F.lit(0)).alias("zeros"),
    )
    n = F.col("n").cast("double")
    spread = F.nullif(F.col("s2"), F.lit(0.0)) / n
    g1, g2 = F.col("s3") / n / spread**1.5, F.col("s4") / n / spread**2 - 3
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    q = quantiles(counts, ["variable"], {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    out = m.join(q, "variable", "left")
    return out.select("variable", "n", "nulls", "distinct", "mean", F.sqrt(F.col("s2") / F.nullif(n - 1, F.lit(0.0))).alias("sd"), "min", "max", skew.alias("skewness"), kurt.alias("kurtosis"), "p5", "p25", "p50", "p75", "p95", "zeros")


def categories(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """variable, rank, value, count, mode: the ``top`` most frequent values of text columns, ties by value, and the first of them."""
    need(df, *columns)
    rows = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "variable", "value").filter("value IS NOT NULL")
    counts = rows.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
    # a variable may have very many values, so each task keeps its own best first
    order = Window.partitionBy("variable", "part").orderBy(F.desc("count"), "value")
    few = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("count"), "value"))).filter(F.col("rank") <= top)
    return ranked.withColumn("mode", F.first("value").over(Window.partitionBy("variable").orderBy("rank"))).select("variable", "rank", "value", "count", "mode")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 1), low, count of equal-width bins, the last closed; one value is widened by 0.5 either way."""
    rows = long(df, [column]).filter("value IS NOT NULL")
    ends = rows.agg(F.min("value").alias("a"), F.max("value").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    ends = F.broadcast(ends)  # one row
    at = F.least(F.floor((F.col("value") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)) + 1, F.lit(bins))
    counts = rows.crossJoin(ends).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.filter("a IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    return grid.join(counts, "bin", "left").select("bin", (F.col("a") + (F.col("bin") - 1) * (F.col("b") - F.col("a")) / bins).alias("low"), F.coalesce("count", F.lit(0)).alias("count"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """distinct, entropy (bits, of shares + 1e-12), most (log2 of distinct), ratio (distinct over rows)."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    total = F.broadcast(counts.agg(F.sum("c").alias("t")))
    p = F.col("c") / F.col("t")
    return counts.crossJoin(total).agg(F.count(F.lit(1)).alias("distinct"), (-F.sum(p * F.log2(p + 1e-12))).alias("entropy"), F.log2(F.count(F.lit(1))).alias("most"), (F.count(F.lit(1)) / F.max("t")).alias("ratio"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, missing, percent, tier: excluded above 50 %, a section of its own from 20 %, else listwise deletion."""
    rows = long(df, columns).groupBy("variable").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))
    percent = 100.0 * F.col("missing") / F.col("n")
    tier = F.when(percent > 50, "excluded").when(percent >= 20, "high_missingness_section").otherwise("listwise_deletion")
    return rows.select("variable", "missing", percent.alias("percent"), tier.alias("tier"))


def missing_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: the correlation of the null indicators of all pairs of ``columns`` in one aggregate; null if either is constant."""
    need(df, *columns)
    x = {c: missing(c, df).cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(correlation(x[a], x[b]).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.nanvl(f"p{k}", F.lit(None).cast("double")).alias("r")) for k, (a, b) in enumerate(pairs)))))


def missing_rows(df: DataFrame, key: str, columns: list[str], top: int = 5) -> DataFrame:
    """rank, key, nulls, incomplete, complete: the ``top`` rows with most nulls, ties by key, beside the numbers of rows with a null and
    without."""
    need(df, key, *columns)
    rows = df.select(F.col(key).alias("key"), sum((missing(c, df).cast("int") for c in columns), F.lit(0)).alias("nulls"))
    whole = rows.agg(F.count_if(F.col("nulls") > 0).alias("incomplete"), F.count_if(F.col("nulls") == 0).alias("complete"))
    worst = rows.filter("nulls > 0").orderBy(F.desc("nulls"), "key").limit(top)
    ranked = worst.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nulls"), "key")))  # ``top`` rows
    return ranked.crossJoin(F.broadcast(whole)).select("rank", "key", "nulls", "incomplete", "complete")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once, such keys, distinct keys, and the most rows of one key; nulls are equal."""
    need(df, *keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("rows"), F.count_if(F.col("c") > 1).alias("keys"), F.count(F.lit(1)).alias("distinct"), F.max("c").alias("most"))


def repeats(df: DataFrame, subject: str, top: int = 5) -> DataFrame:
    """rank, subject, c, subjects, most, mean: the ``top`` subjects by rows, ties by subject, beside the number of distinct subjects and
    the most and the mean rows of one."""
    counts = df.filter(F.col(subject).isNotNull()).groupBy(F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("c"))
    whole = counts.agg(F.count(F.lit(1)).alias("subjects"), F.max("c").alias("most"), F.avg("c").alias("mean"))
    best = counts.orderBy(F.desc("c"), "subject").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("c"), "subject"))).crossJoin(F.broadcast(whole)).select("rank", "subject", "c", "subjects", "most", "mean")  # ``top`` rows, one row


def outliers(df: DataFrame, columns: list[str], fence: float = 1.5, z: float = 3.0, mad: float = 3.5) -> DataFrame:
    """variable, n, iqr, zscore, mad: rows beyond each rule (columns of fewer than 4 values are left out)."""
    counts = saved(counted(long(df, columns), ["variable"]))
    n = F.sum("c")
    mean = F.sum(F.col("c") * F.col("value")) / n
    stats = counts.groupBy("variable").agg(n.alias("n"), mean.alias("mean")).filter("n >= 4")
    q = quantiles(counts, ["variable"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    counts = counts.join(F.broadcast(stats), "variable")  # one row a column of the table
    spread = counts.groupBy("variable").agg(F.sqrt(F.sum(F.col("c") * (F.col("value") - F.col("mean")) ** 2) / (F.max("n") - 1)).alias("sd"))
    counts = counts.join(F.broadcast(q), "variable").join(F.broadcast(spread), "variable")  # the same
    off = F.abs(F.col("value") - F.col("q2"))
    far = counts.select("variable", off.alias("value"), "c").groupBy("variable", "value").agg(F.sum("c").alias("c"))
    counts = counts.join(F.broadcast(quantiles(far, ["variable"], {"m": 0.5})), "variable")
    reach = fence * (F.col("q3") - F.col("q1"))
    rows_if = lambda x: F.coalesce(F.sum(F.when(x, F.col("c"))), F.lit(0))
    return counts.groupBy("variable").agg(
        F.max("n").alias("n"), rows_if((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).alias("iqr"),
        rows_if(F.abs(F.col("value") - F.col("mean")) > z * F.col("sd")).alias("zscore"), rows_if((F.col("m") > 0) & (0.6745 * off / F.col("m") > mad)).alias("mad"),
    )


def outlier_examples(df: DataFrame, key: str, columns: list[str], fence: float = 1.5, top: int = 10) -> DataFrame:
    """variable, rank, key, value: of each column the ``top`` rows beyond its fences that lie farthest from the middle of them, ties by key."""
    rows = long(df, columns, [key]).filter("value IS NOT NULL")
    q = quantiles(counted(rows, ["variable"]), ["variable"], {"q1": 0.25, "q3": 0.75})
    reach = fence * (F.col("q3") - F.col("q1"))
    rows = rows.join(F.broadcast(q), "variable").filter((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach))  # q: one row a column
    rows = rows.withColumn("far", F.abs(F.col("value") - (F.col("q1") + F.col("q3")) / 2)).withColumn("part", F.pmod(F.xxhash64(key), F.lit(64)))
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("far"), key))
    rows = rows.withColumn("r", first(["variable", "part"])).filter(F.col("r") <= top).withColumn("rank", first(["variable"])).filter(F.col("rank") <= top)
    return rows.select("variable", "rank", F.col(key).alias("key"), "value")


def digit_preference(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, chi2 against uniform last digits (9 degrees of freedom), its p, whether it is flagged (p below 0.05), and the dominant
    digit; n of 10 at least."""
    digit = F.pmod(F.bround(F.abs("value")), F.lit(10)).cast("int")
    counts = long(df, columns).filter("value IS NOT NULL").groupBy("variable", digit.alias("digit")).agg(F.count(F.lit(1)).alias("c"))
    out = counts.groupBy("variable").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max_by("digit", F.struct("c", -F.col("digit"))).alias("dominant"))
    out = out.filter("n >= 10").select("variable", "n", (10.0 * F.col("sq") / F.col("n") - F.col("n")).alias("chi2"), "dominant")
    return out.withColumn("p", chi_square_sf("chi2", F.lit(9))).withColumn("flagged", F.col("p") < 0.05)


def balance(df: DataFrame, arm: str, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """variable, n and mean by arm, standardised mean difference of the two arms (in order), and whether it is flagged."""
    arms = [r[0] for r in df.select(arm).filter(F.col(arm).isNotNull()).distinct().limit(3).collect()]
    if len(arms) != 2:
        raise ValueError("two arms are needed")
    lo, hi = sorted(arms)
    table = moments(df, columns, [arm]).groupBy("variable").agg(*(F.max(F.when(F.col(arm) == a, F.col(c))).alias(f"{c}_{k}") for k, a in ((1, lo), (2, hi)) for c in ("n", "mean", "var")))
    smd = (F.col("mean_1") - F.col("mean_2")) / F.sqrt((F.col("var_1") + F.col("var_2")) / 2)
    return table.select("variable", "n_1", "n_2", "mean_1", "mean_2", smd.alias("smd"), (F.abs(smd) > threshold).alias("flagged"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column (null: all), n, share of the whole; pairs with nulls are left out."""
    pairs = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).select(F.col(row).alias("r"), F.col(column).alias("c"))
    cells = pairs.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).cube("r", "c").agg(F.sum("n").alias("n"))
    whole = pairs.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("whole"))
    return cells.crossJoin(F.broadcast(whole)).select("r", "c", "n", (F.col("n") / F.col("whole")).alias("share"))  # one row


def balance_categories(df: DataFrame, arm: str, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """variable, level, share_1, share_2, smd, flagged: of categorical columns the share of every level by arm (in order) among rows with a
    value. The difference of a two-level column is that of its smallest level, p1 - p2 over sqrt((p1 (1 - p1) + p2 (1 - p2)) / 2); others have none."""
    need(df, arm, *columns)
    arms = [r[0] for r in df.select(arm).filter(F.col(arm).isNotNull()).distinct().limit(3).collect()]
    if len(arms) != 2:
        raise ValueError("two arms are needed")
    lo, hi = sorted(arms)
    rows = df.filter(F.col(arm).isin(lo, hi)).select((F.col(arm) == lo).alias("_a"), *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(["_a"], columns, "variable", "level").filter("level IS NOT NULL")
    cells = rows.groupBy("variable", "level").agg(F.count_if("_a").alias("k1"), F.count_if(~F.col("_a")).alias("k2"))
    whole = cells.groupBy("variable").agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"), F.count(F.lit(1)).alias("levels"), F.min("level").alias("first"))
    p1, p2 = F.col("k1") / F.nullif("n1", F.lit(0)), F.col("k2") / F.nullif("n2", F.lit(0))
    smd = F.when((F.col("levels") == 2) & (F.col("level") == F.col("first")), (p1 - p2) / F.nullif(F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2), F.lit(0.0)))
    return cells.join(F.broadcast(whole), "variable").select("variable", "level", p1.alias("share_1"), p2.alias("share_2"), smd.alias("smd"), (F.abs(smd) > threshold).alias("flagged"))  # one row a column
