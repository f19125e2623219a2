"""Linear models from Gram sums: one pass for X'X, X'y, y'y, then algebra on k x k numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.operators.longform import need


def gram(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of (1, xs, y) over complete rows, and their number."""
    need(df, y, *xs)
    rows = df.select(F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in (*xs, y))).dropna()
    cols = ["_one", *xs, y]
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)).first()
    g = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            g[i, j] = g[j, i] = sums[f"s{i}_{j}"] or 0.0
    return g, int(g[0, 0])


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, se (HC3), t, p, low and high (95 %), and of the model n, r2, adjusted_r2, aic, bic, f, f_p: X'X in one pass,
    the HC3 middle in another."""
    g, n = gram(df, y, xs)
    k = len(xs) + 1
    if n < max(k + 1, 10):
        raise ValueError("too few complete rows")
    inverse = np.linalg.pinv(g[:k, :k])
    beta = inverse @ g[:k, k]
    rows = df.select(F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in (*xs, y))).dropna()
    cols = ["_one", *xs]
    fit = sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))
    h = sum((F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols)), F.lit(0.0))
    w = ((F.col(y) - fit) / (1 - h)) ** 2
    middle = rows.agg(F.sum((F.col(y) - fit) ** 2).alias("rss"), *(F.sum(F.col(a) * F.col(b) * w).alias(f"m{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols))).first()
    meat = np.array([[middle[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    total = float(g[k, k] - g[0, k] ** 2 / n)
    r2 = float(1 - middle["rss"] / total) if total > 0 else None
    rss, free = float(middle["rss"]), n - k
    edge = dist.t_quantile(0.05, free)
    like = n * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else None
    f = ((total - rss) / (k - 1)) / (rss / free) if k > 1 and rss > 0 else None
    model = (n, r2, None if r2 is None else 1 - (1 - r2) * (n - 1) / free, None if like is None else like + 2 * k, None if like is None else like + k * math.log(n), f, None if f is None else dist.f_sf(f, k - 1, free))
    out = [("intercept" if c == "_one" else c, float(b), float(s), float(b / s) if s > 0 else None, float(dist.t_two_sided(float(b / s), free)) if s > 0 else None, float(b - edge * s), float(b + edge * s), *model) for c, b, s in zip(cols, beta, se)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, t double, p double, low double, high double, n long, r2 double, adjusted_r2 double, aic double, bic double, f double, f_p double")
