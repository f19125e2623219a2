"""Feature selection from small sufficient statistics: class moments, correlation matrices, Gram sums by fold."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.columns import f_sf
from cohortlake.operators import association as assoc
from cohortlake.operators.longform import correlation, long, need, quantiles, saved


def default_size(candidates: int) -> int:
    """Features kept by default: 75 % of up to 20 candidates, 55 % of more, rounded up, 4 at least."""
    return min(candidates, max(4, math.ceil(candidates * (0.75 if candidates <= 20 else 0.55))))


def univariate(df: DataFrame, outcome: str, columns: list[str]) -> DataFrame:
    """variable, f, p, score (f over the largest) of a one-way analysis of variance of each column over the outcome's
    classes, all in one pass."""
    cells = long(df.filter(F.col(outcome).isNotNull()), columns, [outcome]).filter("value IS NOT NULL").groupBy("variable", outcome).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"))
    m = cells.groupBy("variable").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") ** 2 / F.col("n")).alias("between"), F.sum("ss").alias("within"))
    between = F.col("between") - F.col("s") ** 2 / F.col("n")
    f = F.coalesce((between / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0)), F.lit(0.0))
    out = m.select("variable", "k", "n", f.alias("f"))
    p = f_sf("f", F.col("k") - 1, F.col("n") - F.col("k"))
    top = out.agg(F.max("f").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("variable", "f", p.alias("p"), (F.col("f") / F.nullif("top", F.lit(0.0))).alias("score"))  # top is one row


def redundancy(df: DataFrame, columns: list[str]) -> DataFrame:
    """pairs, mean_abs_r: the mean absolute correlation of all pairs of columns; undefined pairs are left out."""
    return assoc.correlations(df, columns).filter("r IS NOT NULL AND NOT isnan(r)").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.abs("r")).alias("mean_abs_r"))


def relevance(df: DataFrame, outcome: str, columns: list[str]) -> DataFrame:
    """variable, eta2: the share of each numeric column's variance that lies between the classes of the outcome."""
    cells = long(df.filter(F.col(outcome).isNotNull()), columns, [outcome]).filter("value IS NOT NULL").groupBy("variable", outcome).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    total = F.sum("q") - F.sum("s") ** 2 / F.sum("n")
    return cells.groupBy("variable").agg(((F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")) / F.nullif(total, F.lit(0.0))).alias("eta2"))


def relevance_by_kind(df: DataFrame, outcome: str, numbers: list[str], categories: list[str], continuous: bool = False) -> DataFrame:
    """variable, relevance, kind, scaled to a greatest one of 1. For a continuous outcome: |r| of numbers, eta squared of the outcome in the
    classes of categories. For classes: eta squared of numbers in them, Cramer's V of categories."""
    parts = []
    if continuous:
        if numbers:
            r = df.agg(*(F.abs(correlation(F.col(f"`{c}`").cast("double"), F.col(outcome).cast("double"))).alias(f"r{i}") for i, c in enumerate(numbers)))
            parts.append(r.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"r{i}").alias("v"), F.lit("correlation").alias("kind")) for i, c in enumerate(numbers))))))
        parts += [relevance(df, c, [outcome]).select(F.lit(c).alias("variable"), F.col("eta2").alias("v"), F.lit("eta2").alias("kind")) for c in categories]
    else:
        if numbers:
            parts.append(relevance(df, outcome, numbers).select("variable", F.col("eta2").alias("v"), F.lit("eta2").alias("kind")))
        parts += [assoc.chi_square(df, c, outcome).select(F.lit(c).alias("variable"), F.col("cramers_v").alias("v"), F.lit("cramers_v").alias("kind")) for c in categories]
    if not parts:
        raise ValueError("no columns")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = saved(out.withColumn("v", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0))))
    return out.crossJoin(F.broadcast(out.agg(F.max("v").alias("top")))).select("variable", (F.col("v") / F.nullif("top", F.lit(0.0))).alias("relevance"), "kind")  # one row


def univariate_regression(df: DataFrame, outcome: str, columns: list[str], top: int | None = None) -> DataFrame:
    """variable, f, p, n, rank: F of the regression of a continuous outcome on each number by itself, from one pass; the ``top`` largest, ties by name."""
    y = F.col(outcome).cast("double")
    each = df.agg(*(F.struct(correlation(F.col(f"`{c}`").cast("double"), y).alias("r"), F.count_if(F.col(f"`{c}`").isNotNull() & y.isNotNull()).alias("n")).alias(f"c{i}") for i, c in enumerate(columns)))
    rows = each.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"c{i}.r").alias("r"), F.col(f"c{i}.n").alias("n")) for i, c in enumerate(columns)))))
    f = F.col("r") ** 2 / F.nullif(1 - F.col("r") ** 2, F.lit(0.0)) * (F.col("n") - 2)
    rows = rows.filter("n > 2").withColumn("f", f).withColumn("p", f_sf("f", F.lit(1.0), F.col("n") - 2))
    out = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("f"), "variable")))  # a row a column
    return out.filter(F.col("rank") <= (top or len(columns))).select("variable", "f", "p", "n", "rank")


def _matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    at = {c: i for i, c in enumerate(columns)}
    out = np.eye(len(columns))
    for r in assoc.correlations(df, columns).collect():  # pairs of columns
        v = r["r"] if r["r"] is not None and r["r"] == r["r"] else 0.0
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = v
    return out


def mutual_information(df: DataFrame, outcome: str, columns: list[str], bins: int = 10) -> DataFrame:
    """variable, mi (nats) between quantile bins of each column and the classes of the outcome."""
    rows = long(df.filter(F.col(outcome).isNotNull()), columns, [outcome]).filter("value IS NOT NULL")
    rows = saved(rows.groupBy("variable", outcome, "value").agg(F.count(F.lit(1)).alias("c")))  # the table is read once
    cuts = quantiles(rows.groupBy("variable", "value").agg(F.sum("c").alias("c")), ["variable"], {f"q{k}": k / bins for k in range(1, bins)})
    cuts = cuts.select("variable", F.array(*(f"q{k}" for k in range(1, bins))).alias("cuts"))
    binned = rows.join(F.broadcast(cuts), "variable").withColumn("bin", F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("value"))))
    cells = saved(binned.groupBy("variable", "bin", outcome).agg(F.sum("c").alias("c")))  # bins by classes; read four times
    a, b, n = cells.groupBy("variable", "bin").agg(F.sum("c").alias("ca")), cells.groupBy("variable", outcome).agg(F.sum("c").alias("cb")), cells.groupBy("variable").agg(F.sum("c").alias("n"))
    joined = cells.join(a, ["variable", "bin"]).join(b, ["variable", outcome]).join(n, "variable")
    return joined.groupBy("variable").agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / F.col("ca") / F.col("cb"))).alias("mi"))


def mrmr(df: DataFrame, outcome: str, columns: list[str], size: int | None = None) -> DataFrame:
    """rank, variable, score: greedy choice of relevance (scaled mutual information) less mean absolute correlation with
    those chosen before; ties by the order of ``columns``."""
    mi = {r["variable"]: r["mi"] for r in mutual_information(df, outcome, columns).collect()}  # one row a column
    rel = np.array([mi.get(c) or 0.0 for c in columns])
    rel = (rel - rel.min()) / (np.ptp(rel) or 1.0)
    r, chosen, out = np.abs(_matrix(df, columns)), [], []
    for k in range(size or default_size(len(columns))):
        score = rel - (r[:, chosen].mean(axis=1) if chosen else 0.0)
        score[chosen] = -np.inf
        best = int(score.argmax())
        chosen.append(best)
        out.append((k + 1, columns[best], float(score[best])))
    return df.sparkSession.createDataFrame(out, "rank long, variable string, score double")


def _descend(g: np.ndarray, c: np.ndarray, l1: float, l2: float, start: np.ndarray, sweeps: int = 1000, tol: float = 1e-9) -> np.ndarray:
    """Coordinate descent on means of products: g of features, c with the outcome."""
    beta = start.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(beta)):
            z = c[j] - g[j] @ beta + g[j, j] * beta[j]
            new = math.copysign(max(abs(z) - l1, 0.0), z) / (g[j, j] + l2) if g[j, j] > 0 else 0.0
            most, beta[j] = max(most, abs(new - beta[j])), new
        if most < tol:
            break
    return beta


def elastic_net(df: DataFrame, key: str, outcome: str, columns: list[str], ratio: float = 1.0, folds: int = 5, size: int | None = None) -> DataFrame:
    """variable, coef (of standardised columns), score, selected: lasso at ratio 1, its strength by cross-validation.

    One pass sums products by fold of the key's hash; all strengths and folds are then fitted on k x k numbers. The
    selection is the non-zero coefficients, padded or cut to ``size`` by absolute coefficient.
    """
    need(df, key, outcome, *columns)
    k, names = len(columns), [*columns, outcome]
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(folds)).alias("_fold"), *(F.col(c).cast("double").alias(c) for c in names)).dropna()
    scale = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    rows = rows.select("_fold", F.lit(1.0).alias("_one"), *(((F.col(c) - float(scale[f"m_{c}"])) / float(scale[f"s_{c}"] or 1.0)).alias(c) for c in names))
    all_ = ["_one", *names]
    sums = rows.groupBy("_fold").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(all_) for j, b in enumerate(all_) if i <= j)).collect()  # one row a fold
    gram = {r["_fold"]: np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)]) for r in sums}
    whole = sum(gram.values())

    def centred(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = s / s[0, 0]
        mean = s[0, 1:]
        c = s[1:, 1:] - np.outer(mean, mean)
        return c[:k, :k], c[:k, k]

    strengths = np.logspace(1, -4, 100)
    errors = np.zeros(len(strengths))
    for s in gram.values() if len(gram) > 1 else ():
        g, c = centred(whole - s)
        mean, beta = (whole - s)[0, 1:] / (whole - s)[0, 0], np.zeros(k)
        for i, strength in enumerate(strengths):
            beta = _descend(g, c, strength * ratio, strength * (1 - ratio), beta)
            full = np.concatenate([[-(mean[k] - mean[:k] @ beta)], -beta, [1.0]])  # residual as a combination
            errors[i] += float(full @ s @ full)
    g, c = centred(whole)
    beta = np.zeros(k)
    for strength in strengths[: int(errors.argmin()) + 1]:
        beta = _descend(g, c, strength * ratio, strength * (1 - ratio), beta)
    order = sorted(range(k), key=lambda j: (-abs(beta[j]), j))
    kept = set(order[: size or default_size(k)])
    top = abs(beta[order[0]]) or 1.0
    return df.sparkSession.createDataFrame([(c, float(b), float(abs(b) / top), j in kept) for j, (c, b) in enumerate(zip(columns, beta))], "variable string, coef double, score double, selected boolean")


def diverse(df: DataFrame, outcome: str, columns: list[str], must: list[str] = (), size: int = 7) -> DataFrame:
    """rank, variable: those asked for, then the most relevant, then always the one least correlated with any chosen;
    ties by relevance, then name."""
    rel = {r["variable"]: r["eta2"] or 0.0 for r in relevance(df, outcome, columns).collect()}  # one row a column
    r = np.abs(_matrix(df, columns))
    chosen = [columns.index(c) for c in must]
    while len(chosen) < min(size, len(columns)):
        rest = [j for j in range(len(columns)) if j not in chosen]
        chosen.append(min(rest, key=lambda j: (r[j, chosen].max() if chosen else 0.0, -rel.get(columns[j], 0.0), columns[j])))
    return df.sparkSession.createDataFrame([(i + 1, columns[j]) for i, j in enumerate(chosen)], "rank long, variable string")


def pair_strengths(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """a, b, strength: absolute correlation of numbers, Cramer's V (without continuity) of categories, scaled to a greatest one of 1: how much two
    columns of one kind repeat each other."""
    parts = []
    if len(numbers) > 1:
        parts.append(assoc.correlations(df, numbers).select("a", "b", F.coalesce(F.abs(F.nanvl("r", F.lit(None).cast("double"))), F.lit(0.0)).alias("v")))
    for i, a in enumerate(categories):
        for b in categories[i + 1 :]:
            parts.append(assoc.chi_square(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce("cramers_v", F.lit(0.0)).alias("v")))
    if not parts:
        raise ValueError("two columns of one kind are needed")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    top = out.agg(F.max("v").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("a", "b", (F.col("v") / F.nullif("top", F.lit(0.0))).alias("strength"))  # one row


def subset_scores(subsets: DataFrame, relevance_: DataFrame, pairs: DataFrame, penalty: float = 0.5, parsimony: float = 0.0) -> DataFrame:
    """subset, size, relevance, redundancy, objective of (subset, variable) rows: less the sum of relevances, plus the sum of the pairs' strengths times
    penalty * (0.8 + 0.4 * mean strength of all pairs), plus ``parsimony`` for each variable; lower is better."""
    need(subsets, "subset", "variable"), need(relevance_, "variable", "relevance"), need(pairs, "a", "b", "strength")
    mean = pairs.agg(F.coalesce(F.avg("strength"), F.lit(0.0)).alias("mean"))
    own = subsets.join(relevance_, "variable", "left").groupBy("subset").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("relevance"), F.lit(0.0)).alias("relevance"))
    x, y = subsets.select("subset", F.col("variable").alias("a")), subsets.select("subset", F.col("variable").alias("b"))
    both = x.join(pairs, "a").join(y, ["subset", "b"]).groupBy("subset").agg(F.sum("strength").alias("redundancy"))
    out = own.join(both, "subset", "left").fillna(0.0, ["redundancy"]).crossJoin(F.broadcast(mean))  # one row
    return out.select("subset", "size", "relevance", "redundancy", (-F.col("relevance") + penalty * (0.8 + 0.4 * F.col("mean")) * F.col("redundancy") + parsimony * F.col("size")).alias("objective"))


def select_features(df: DataFrame, outcome: str, columns: list[str], method: str = "univariate", size: int | None = None, key: str | None = None) -> DataFrame:
    """variable, score, selected by one of none, univariate, mrmr, lasso and elastic_net; ``size`` features, by default ``default_size``."""
    n = min(len(columns), size or default_size(len(columns)))
    if method == "none":
        return df.sparkSession.createDataFrame([(c, 1.0, True) for c in columns], "variable string, score double, selected boolean")
    if method in ("lasso", "elastic_net"):
        return elastic_net(df, key or columns[0], outcome, columns, 1.0 if method == "lasso" else 0.5, size=n).select("variable", "score", "selected")
    if method not in ("univariate", "mrmr"):
        raise ValueError(f"no such method: {method}")
    found = univariate(df, outcome, columns).select("variable", "score") if method == "univariate" else mrmr(df, outcome, columns, len(columns)).select("variable", "score", "rank")
    order = ["rank"] if method == "mrmr" else [F.desc("score"), F.col("variable")]
    return found.withColumn("_r", F.row_number().over(Window.orderBy(*order))).select("variable", "score", (F.col("_r") <= n).alias("selected"))  # one row a column


def stability(df: DataFrame, key: str, outcome: str, columns: list[str], replicates: int = 10, size: int | None = None) -> DataFrame:
    """variable, frequency: the share of ``replicates`` Poisson resamples, whose weights are a hash of key and replicate, in which analysis of
    variance selects the column. All replicates are sums of one pass."""
    n = min(len(columns), size or default_size(len(columns)))
    rows = long(df.filter(F.col(outcome).isNotNull()), columns, [key, outcome]).filter("value IS NOT NULL")
    u = (F.pmod(F.xxhash64(key, "replicate"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cuts = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)])
    weight = sum(((u > float(c)).cast("int") for c in cuts), F.lit(0))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight).filter("w > 0")
    cells = drawn.groupBy("replicate", "variable", outcome).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(F.col("w") * F.col("value") ** 2).alias("q"))
    m = cells.groupBy("replicate", "variable").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")).alias("between"), (F.sum("q") - F.sum(F.col("s") ** 2 / F.col("n"))).alias("within"))
    f = F.coalesce(F.col("between") / (F.col("k") - 1) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0)), F.lit(0.0))
    ranked = m.withColumn("r", F.row_number().over(Window.partitionBy("replicate").orderBy(f.desc(), "variable")))
    return ranked.groupBy("variable").agg((F.count_if(F.col("r") <= n) / float(replicates)).alias("frequency"))
