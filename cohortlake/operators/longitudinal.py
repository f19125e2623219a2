"""Repeated measures and missing values: mixed models from sums by subject, chained imputation from Gram sums, concordance."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.operators.longform import need, saved
from cohortlake.operators.order import Ranges, dominated


def _levels(df: DataFrame, column: str, most: int = 50) -> list:
    """The levels of a factor of a model, in order; more than ``most`` make no factor."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return found


def _random_intercept(df: DataFrame, subject: str, y: str, design: dict[str, F.Column]) -> DataFrame:
    """term, coef, se, z, p, rows, subjects, residual, between (variances), reml: a linear model with a random intercept for each subject.

    With a variance ratio r the inverse covariance of a subject's n rows is (I - r / (1 + n r) J) / s2, so sums of products over all rows and, for
    each n, over the subjects' column sums are all that the likelihood needs: one aggregate by subject, one by n. The ratio is searched here.
    """
    names = [*design, "_y"]
    k = len(names)
    rows = df.select(F.col(subject).alias("_s"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(design.values())), F.col(y).cast("double").alias(f"x{k - 1}")).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    each = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(k)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs))
    sums = each.groupBy("n").agg(F.count(F.lit(1)).alias("m"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(f"g{i}_{j}").alias(f"g{i}_{j}") for i, j in pairs)).collect()  # one row a number of visits

    def square(r, name: str) -> np.ndarray:
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = r[f"{name}{i}_{j}"]
        return out

    blocks = [(r["n"], r["m"], square(r, "s")) for r in sums]
    gram = sum((square(r, "g") for r in sums), np.zeros((k, k)))
    total, subjects, p = sum(n * m for n, m, _ in blocks), sum(m for _, m, _ in blocks), k - 1
    if total < max(6, p + 2):
        raise ValueError("too few complete rows")

    def fit(r: float):
        w = gram - sum(r / (1 + n * r) * s for n, _, s in blocks)
        inverse = np.linalg.pinv(w[:p, :p])
        beta = inverse @ w[:p, p]
        s2 = float(w[p, p] - beta @ w[:p, p]) / (total - p)
        values = np.linalg.eigvalsh(w[:p, :p])
        like = -0.5 * ((total - p) * (math.log(2 * math.pi * s2) + 1) + sum(m * math.log1p(n * r) for n, m, _ in blocks) + float(np.log(values[values > 1e-10 * values.max()]).sum()))
        return like, beta, inverse * s2, s2

    grid = [0.0, *np.exp(np.linspace(-12, 8, 81))]
    at = max(range(len(grid)), key=lambda i: fit(grid[i])[0])
    low, high, gold = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)], (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if fit(a)[0] > fit(b)[0] else (a, high)
    ratio = max((low, (low + high) / 2, grid[at]), key=lambda r: fit(r)[0])
    like, beta, covariance, s2 = fit(ratio)
    out = [(name, float(b), (se := math.sqrt(max(0.0, v))), float(b / se) if se else None, 2 * dist.normal_sf(abs(b / se)) if se else None, total, subjects, s2, ratio * s2, like) for name, b, v in zip(design, beta, np.diag(covariance))]
    return df.sparkSession.createDataFrame([tuple(None if x is None else float(x) if isinstance(x, np.floating) else x for x in r) for r in out], "term string, coef double, se double, z double, p double, rows long, subjects long, residual double, between double, reml double")


def repeated_measures_model(df: DataFrame, subject: str, time: str, arm: str, y: str, covariates: list[str] = ()) -> DataFrame:
    """As ``_random_intercept`` of y on time, arm, their interaction (first levels as reference) and covariates, by restricted likelihood."""
    need(df, subject, time, arm, y, *covariates)
    times, arms = _levels(df, time), _levels(df, arm)
    if len(times) < 2 or len(arms) < 2:
        raise ValueError("two times and two arms are needed")
    is_ = lambda c, v: (F.col(c) == v).cast("double")
    design = {"intercept": F.lit(1.0)}
    design |= {f"{time}[{t}]": is_(time, t) for t in times[1:]} | {f"{arm}[{a}]": is_(arm, a) for a in arms[1:]}
    design |= {f"{time}[{t}]:{arm}[{a}]": is_(time, t) * is_(arm, a) for t in times[1:] for a in arms[1:]} | {c: F.col(c) for c in covariates}
    return _random_intercept(df, subject, y, design)


def constrained_model(df: DataFrame, subject: str, time: str, arm: str, y: str) -> DataFrame:
    """As ``repeated_measures_model`` with equal arms at the first time: arms differ at later times only."""
    need(df, subject, time, arm, y)
    times, arms = _levels(df, time), _levels(df, arm)
    if len(times) < 2 or len(arms) < 2:
        raise ValueError("two times and two arms are needed")
    is_ = lambda c, v: (F.col(c) == v).cast("double")
    design = {"intercept": F.lit(1.0)} | {f"{time}[{t}]": is_(time, t) for t in times[1:]}
    return _random_intercept(df, subject, y, design | {f"{time}[{t}]:{arm}[{a}]": is_(time, t) * is_(arm, a) for t in times[1:] for a in arms[1:]})


def imputed(df: DataFrame, key: str, targets: list[str], predictors: list[str], copies: int = 5, sweeps: int = 10, seed: int = 42) -> DataFrame:
    """copy (from 1) and all columns of ``df``, ``targets`` without missing values where the predictors are there: chained equations.

    Each sweep regresses every target in turn on the predictors and the other targets, by sums of products over the rows
    where it was seen, a set of sums a copy; missing values become the prediction and normal noise drawn from a hash of key, copy, target and
    sweep, so that reruns agree. A target starts from its mean.

    Rows that miss no target are summed once, for all sweeps and copies. Only rows that miss one are written in each sweep, with the copies beside
    each other. A single target depends on no earlier sweep, so its last sweep is all that is done, and nothing is written.
    """
    need(df, key, *targets, *predictors)
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (*targets, *predictors)}
    means = df.agg(*(F.avg(number[t]).alias(t) for t in targets)).first()
    kept, drawn = [c for c in df.columns if c not in targets], range(1, copies + 1)
    rows = df.select(*kept, *(number[t].alias(t) for t in targets), *(number[t].isNull().alias(f"_gone_{t}") for t in targets))
    at = lambda copy, t: f"_copy{copy}_{t}"
    some_gone = reduce(lambda a, b: a | b, [F.col(f"_gone_{t}") for t in targets])
    names = ["_one", *predictors, *targets]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    col = lambda c: F.lit(1.0) if c == "_one" else F.col(c).cast("double")
    products = [F.sum(col(names[i]) * col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]

    def square(r) -> np.ndarray:
        out = np.zeros((len(names), len(names)))
        for i, j in pairs:
            out[i, j] = out[j, i] = (r[f"g{i}_{j}"] or 0.0) if r is not None else 0.0
        return out

    full = square(rows.filter(~some_gone).agg(*products).first())
    holed = rows.filter(some_gone).withColumns({at(copy, t): F.coalesce(F.col(t), F.lit(means[t])) for copy in drawn for t in targets})
    each = lambda rows: rows.withColumn("_all", F.explode(F.array(*(F.struct(F.lit(copy).alias("copy"), *(F.col(at(copy, t)).alias(t) for t in targets)) for copy in drawn))))
    for sweep in range(sweeps) if len(targets) > 1 else range(sweeps)[-1:]:
        for t in targets:
            seen = each(holed.filter(~F.col(f"_gone_{t}")).drop(*targets)).select("*", "_all.*").groupBy("copy").agg(*products).collect() if len(targets) > 1 else []  # one row a copy
            seen = {r["copy"]: r for r in seen}
            xs = ["_one", *predictors, *(o for o in targets if o != t)]
            own = [names.index(c) for c in (*xs, t)]
            k = len(xs)
            u = lambda copy, salt: (F.pmod(F.xxhash64(F.col(key), F.lit(copy), F.lit(t), F.lit(sweep), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)  # noqa: E731, B023
            filled = {}
            for copy in drawn:
                g = (full + square(seen.get(copy)))[np.ix_(own, own)]
                if not g[0, 0]:  # never seen
                    continue
                ridge = 1e-6 * np.trace(g[:k, :k]) / k * np.eye(k)
                beta = np.linalg.solve(g[:k, :k] + ridge, g[:k, k])
                rest = g[k, k] - 2 * beta @ g[:k, k] + beta @ g[:k, :k] @ beta
                spread = math.sqrt(max(0.0, rest) / max(1.0, g[0, 0] - k))
                noise = F.sqrt(-2 * F.log(u(copy, 1))) * F.cos(2 * math.pi * u(copy, 2))
                x = {c: F.col(at(copy, c)) if c in targets else col(c) for c in xs}
                guess = sum((x[c] * float(b) for c, b in zip(xs, beta)), F.lit(0.0)) + float(spread) * noise
                filled[at(copy, t)] = F.when(F.col(f"_gone_{t}"), F.coalesce(guess, F.col(at(copy, t)))).otherwise(F.col(at(copy, t)))
            holed = holed.withColumns(filled)
        holed = saved(holed) if len(targets) > 1 else holed
    whole = rows.filter(~some_gone).withColumns({at(copy, t): F.col(t) for copy in drawn for t in targets})
    out = each(whole.unionByName(holed).drop(*targets)).select("_all.copy", *kept, *(F.col("_all").getField(t).alias(t) for t in targets))
    return out.select("copy", *df.columns)


def pooled(filled: DataFrame, targets: list[str]) -> DataFrame:
    """variable, n, mean, within, between, total, low, high: Rubin's rules for the means of ``imputed`` columns. Within is the variance of a mean."""
    rows = filled.select("copy", *targets).unpivot(["copy"], targets, "variable", "value").filter("value IS NOT NULL")
    each = rows.groupBy("variable", "copy").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("q"), (F.var_samp("value") / F.count(F.lit(1))).alias("u"))
    m = each.groupBy("variable").agg(F.max("n").alias("n"), F.avg("q").alias("mean"), F.avg("u").alias("within"), F.coalesce(F.var_samp("q"), F.lit(0.0)).alias("between"), F.count(F.lit(1)).alias("m"))
    total, z = F.col("within") + (1 + 1 / F.col("m")) * F.col("between"), NormalDist().inv_cdf(0.975)
    out = m.withColumn("total", total)
    return out.select("variable", "n", "mean", "within", "between", "total", (F.col("mean") - z * F.sqrt("total")).alias("low"), (F.col("mean") + z * F.sqrt("total")).alias("high"))


def completed(df: DataFrame, key: str, targets: list[str], predictors: list[str], sweeps: int = 10) -> DataFrame:
    """``df`` once with its targets imputed."""
    return imputed(df, key, targets, predictors, 1, sweeps).drop("copy")


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """pairs, concordant, tied, c_index: of pairs of which the one with an event came first, the share in which it had the higher risk, ties half.

    At one time, rows without an event outlive those with one. Rows collapse to cells of equal time, event and risk; pairs of
    cells are counted by ``order.dominated``, those of equal risk and all comparable ones by running sums over ranges of times.
    """
    need(df, time, event, risk)
    rows = df.select(F.col(time).cast("double").alias("t"), (F.coalesce(F.col(event).cast("int"), F.lit(0)) == 0).cast("int").alias("out"), (-F.col(risk).cast("double")).alias("r")).filter("NOT isnan(r)").dropna().filter("t > 0")
    cells = saved(rows.groupBy("t", "out", "r").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("out") == 0).alias("d")))

    def later(by: list[str]) -> DataFrame:
        """Sum of events times rows that stand after them, in the groups of ``by``."""
        each = cells.groupBy(*by, "t", "out").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
        ranges = Ranges(each, by, ["t", "out"])
        return ranges.running(ranges.rows, reverse=True, upto=("sum", "c")).agg(F.coalesce(F.sum(F.col("d").cast("decimal(19,0)") * (F.col("upto") - F.col("c")).cast("decimal(19,0)")).cast("decimal(38,0)"), F.lit(0)).alias("total"))

    parts = {"pairs": later([]), "concordant": dominated(cells, ["t", "out"], "r", "d", "c"), "tied": later(["r"])}
    one = None
    for name, part in parts.items():
        part = part.select(F.col("total").cast("long").alias(name))
        one = part if one is None else one.crossJoin(part)  # one row each
    return one.withColumn("c_index", (F.col("concordant") + 0.5 * F.col("tied")) / F.nullif("pairs", F.lit(0)))
