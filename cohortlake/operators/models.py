"""Logistic and Cox regression, analysis of covariance, and Little's test: Spark sums per iteration, k x k algebra here."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.operators import regression
from cohortlake.operators.longform import need, saved
from cohortlake.operators.longitudinal import concordance
from cohortlake.operators.order import Ranges


def _linear(cols: list[str], beta) -> F.Column:
    return sum((F.col(c) * float(b) for c, b in zip(cols, beta)), F.lit(0.0))


def _square(row, name: str, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"] or 0.0
    return out


def logistic(df: DataFrame, y: str, xs: list[str], steps: int = 25, tol: float = 1e-10) -> DataFrame:
    """term, coef, se, odds_ratio, z, p, low and high (of the odds ratio, 95 %), n, mcfadden_r2, aic, bic of a 0/1 outcome over
    complete rows, by Newton steps of one aggregate each over distinct patterns of the covariates. Separation shows as coefficients still growing after ``steps``: an error."""
    need(df, y, *xs)
    cols = ["_one", *xs]
    k = len(cols)
    rows = df.select(F.lit(1.0).alias("_one"), *(F.col(c).cast("double").alias(c) for c in (*xs, y))).dropna()
    rows = saved(rows.groupBy(*cols, y).agg(F.count(F.lit(1)).alias("_m")))  # patterns, however often they occur; each step reads them
    m = F.col("_m")
    beta = np.zeros(k)
    for _ in range(steps):
        eta = _linear(cols, beta)
        p = 1 / (1 + F.exp(-eta))
        like = F.col(y) * eta - F.when(eta > 0, eta + F.log1p(F.exp(-eta))).otherwise(F.log1p(F.exp(eta)))
        s = rows.agg(
            F.sum("_m").alias("n"), (F.sum(m * F.col(y)) / F.sum("_m")).alias("mean"), F.sum(m * like).alias("like"),
            *(F.sum(m * F.col(c) * (F.col(y) - p)).alias(f"u{i}") for i, c in enumerate(cols)),
            *(F.sum(m * F.col(a) * F.col(b) * p * (1 - p)).alias(f"h{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j),
        ).first()
        if not s["n"] or s["mean"] in (0.0, 1.0):
            raise ValueError("both outcomes are needed")
        inverse = np.linalg.pinv(_square(s, "h", k))
        step = inverse @ np.array([s[f"u{i}"] for i in range(k)])
        if np.abs(step).max() < tol:
            break
        beta = beta + step
    else:
        raise ValueError("no convergence: the outcomes may be separated")
    n, mean = s["n"], s["mean"]
    null = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean))
    se, like, z = np.sqrt(np.diag(inverse)), s["like"], NormalDist().inv_cdf(0.975)
    out = [("intercept" if c == "_one" else c, float(b), float(e), math.exp(b), float(b / e), 2 * dist.normal_sf(abs(b / e)), math.exp(b - z * e), math.exp(b + z * e), n, 1 - like / null, 2 * k - 2 * like, k * math.log(n) - 2 * like) for c, b, e in zip(cols, beta, se)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, odds_ratio double, z double, p double, low double, high double, n long, mcfadden_r2 double, aic double, bic double")


def cox(df: DataFrame, time: str, event: str, xs: list[str], steps: int = 30, tol: float = 1e-9) -> DataFrame:
    """term, coef, hazard_ratio, se, z, p, low and high (of the hazard ratio, 95 %), n, events, log_likelihood, c_index, with Efron's ties; rows
    need a positive time.

    Each Newton step sums weights by distinct time first; risk sets are running sums over ranges of distinct times. Tied events
    are spread over their own rows, so a step costs one pass and as many rows as events.
    """
    need(df, time, event, *xs)
    k = len(xs)
    rows = df.select(F.col(time).cast("double").alias("_t"), F.coalesce(F.col(event).cast("int"), F.lit(0)).alias("_e"), *(F.col(c).cast("double").alias(c) for c in xs)).dropna().filter("_t > 0")
    means = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("events"), *(F.avg(c).alias(c) for c in xs)).first()
    if not means["events"]:
        raise ValueError("no events")
    times = Ranges(rows.select("_t").distinct(), [], ["_t"])  # each step reads rows with the range of their time
    rows = saved(rows.select("_t", "_e", *((F.col(c) - float(means[c])).alias(c) for c in xs)).join(times.rows, "_t"))
    pairs = [(i, j) for i in range(k) for j in range(k) if i <= j]
    beta = np.zeros(k)
    for _ in range(steps):
        r = F.exp(_linear(xs, beta))
        terms = {"r": r, **{f"x{i}": r * F.col(c) for i, c in enumerate(xs)}, **{f"q{i}_{j}": r * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs}}
        dead = F.col("_e") == 1
        at = rows.groupBy("_t", "_range").agg(F.sum("_e").alias("d"), F.sum(F.when(dead, _linear(xs, beta)).otherwise(0.0)).alias("fit"), *(F.sum(F.when(dead, F.col(c)).otherwise(0.0)).alias(f"m{i}") for i, c in enumerate(xs)), *(F.sum(v).alias(f"O{n}") for n, v in terms.items()), *(F.sum(F.when(dead, v).otherwise(0.0)).alias(f"D{n}") for n, v in terms.items()))
        at = times.running(at, reverse=True, **{f"R{n}": ("sum", f"O{n}") for n in terms}).filter("d > 0")
        tied = at.withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)))
        share = F.col("l") / F.col("d")
        tied = tied.select("l", "fit", *(f"m{i}" for i in range(k)), *((F.col(f"R{n}") - share * F.col(f"D{n}")).alias(n) for n in terms))
        once = F.col("l") == 0
        s = tied.agg(
            (F.sum(F.when(once, F.col("fit")).otherwise(0.0)) - F.sum(F.log("r"))).alias("like"),
            *((F.sum(F.when(once, F.col(f"m{i}")).otherwise(0.0)) - F.sum(F.col(f"x{i}") / F.col("r"))).alias(f"u{i}") for i in range(k)),
            *(F.sum(F.col(f"q{i}_{j}") / F.col("r") - F.col(f"x{i}") * F.col(f"x{j}") / F.col("r") ** 2).alias(f"h{i}_{j}") for i, j in pairs),
        ).first()
        inverse = np.linalg.pinv(_square(s, "h", k))
        step = inverse @ np.array([s[f"u{i}"] for i in range(k)])
        if np.abs(step).max() < tol:
            break
        beta = beta + step
    else:
        raise ValueError("no convergence")
    se, z = np.sqrt(np.diag(inverse)), NormalDist().inv_cdf(0.975)
    c = concordance(rows.withColumn("_risk", _linear(xs, beta)), "_t", "_e", "_risk").first()["c_index"]
    out = [(x, float(b), math.exp(b), float(e), float(b / e), 2 * dist.normal_sf(abs(b / e)), math.exp(b - z * e), math.exp(b + z * e), means["n"], means["events"], s["like"], c) for x, b, e in zip(xs, beta, se)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, hazard_ratio double, se double, z double, p double, low double, high double, n long, events long, log_likelihood double, c_index double")


def ancova(df: DataFrame, outcome: str, arm: str, covariates: list[str], a, b) -> DataFrame:
    """coef (b less a, adjusted), se, t, p, mean_a, mean_b (adjusted means at the covariates' means), n, r2."""
    rows = df.filter(F.col(arm).isin(a, b)).select(outcome, (F.col(arm) == b).cast("double").alias("_arm"), *covariates).dropna()
    fit = {r["term"]: r for r in regression.ols(rows, outcome, ["_arm", *covariates]).collect()}  # one row a term
    centre = rows.agg(*(F.avg(c).alias(c) for c in covariates)).first() if covariates else {}
    base = fit["intercept"]["coef"] + sum(fit[c]["coef"] * centre[c] for c in covariates)
    own = fit["_arm"]
    return df.sparkSession.createDataFrame([(own["coef"], own["se"], own["t"], own["p"], base, base + own["coef"], own["n"], own["r2"])], "coef double, se double, t double, p double, mean_a double, mean_b double, n long, r2 double")


def ancova_arms(df: DataFrame, outcome: str, arm: str, covariates: list[str], arms: list, interaction: bool = False) -> DataFrame:
    """term, coef, se, t, p, low, high, mean, n, r2 of the outcome on any number of arms (the first of ``arms`` as reference) and covariates,
    with arm by covariate terms if asked for: HC3 errors. Terms are ``arm[b]``, covariates, ``arm[b]:covariate``; the reference's row is
    ``arm[a]`` with coefficient 0. mean is an arm's adjusted mean, at the covariates' means."""
    need(df, outcome, arm, *covariates)
    if len(arms) < 2:
        raise ValueError("two arms are needed")
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (outcome, *covariates)}
    rows = df.filter(F.col(arm).isin(*arms)).select(F.col(arm).alias("_arm"), *(number[c].alias(f"_{i}") for i, c in enumerate((outcome, *covariates)))).dropna()
    names = [f"_{i + 1}" for i in range(len(covariates))]
    centre = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in names)).first()
    if not centre["n"]:
        raise ValueError("no complete rows")
    # about their means, so that products do not cancel and the reference's mean is the intercept
    moved = {c: F.col(c) - float(centre[c]) for c in names}
    is_ = {f"_is{k}": (F.col("_arm") == b).cast("double") for k, b in enumerate(arms[1:])}
    both = {f"{i}{c}": x * moved[c] for i, x in is_.items() for c in names} if interaction else {}
    design = rows.select("_0", *(x.alias(n) for n, x in {**is_, **moved, **both}.items()))
    fit = {r["term"]: r for r in regression.ols(design, "_0", [*is_, *names, *both]).collect()}  # one row a term
    said = {f"_is{k}": f"{arm}[{b}]" for k, b in enumerate(arms[1:])} | dict(zip(names, covariates))
    said |= {f"{i}{c}": f"{said[i]}:{said[c]}" for i in is_ for c in names} if interaction else {}
    base, any_ = fit["intercept"]["coef"], fit["intercept"]
    out = [(f"{arm}[{arms[0]}]", 0.0, None, None, None, None, None, base, any_["n"], any_["r2"])]
    for term, name in said.items():
        r = fit[term]
        out.append((name, r["coef"], r["se"], r["t"], r["p"], r["low"], r["high"], base + r["coef"] if term in is_ else None, r["n"], r["r2"]))
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, t double, p double, low double, high double, mean double, n long, r2 double")


def little(df: DataFrame, columns: list[str]) -> DataFrame:
    """chi2, df, p, patterns: whether values are missing completely at random (p of 0.05 and more), from the means of each
    pattern of missingness, at most 2 to the number of columns (15 at most)."""
    need(df, *columns)
    if not 2 <= len(columns) <= 15:
        raise ValueError("2 to 15 columns")
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    mask = sum((x[c].isNotNull().cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))
    patterns = df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x[c]).alias(c) for c in columns)).collect()
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns)) if i <= j]
    whole = df.agg(*(F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(x[columns[i]], x[columns[j]]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    covariance = _square(whole, "c", len(columns))
    chi2, observed, gone = 0.0, 0, 0
    for r in patterns:
        have = [i for i in range(len(columns)) if r["mask"] >> i & 1]
        gone |= ~r["mask"]
        if have:
            gap = np.array([r[columns[i]] - whole[f"m{i}"] for i in have])
            chi2 += r["n"] * float(gap @ np.linalg.pinv(covariance[np.ix_(have, have)]) @ gap)
            observed += len(have)
    free = observed - sum(gone >> i & 1 for i in range(len(columns)))
    p = dist.chi2_sf(chi2, free) if free > 0 and len(patterns) > 1 else None
    return df.sparkSession.createDataFrame([(chi2, free, p, len(patterns))], "chi2 double, df long, p double, patterns long")


def little_likelihood(df: DataFrame, columns: list[str], steps: int = 1000) -> DataFrame:
    """As ``little``, with the means and covariances of maximum likelihood, and its degrees of freedom: the ranks of the patterns less that of the whole.

    One aggregate gives the sums of each pattern; expectation maximisation over patterns runs here. Directions in which columns repeat each
    other have no variance and count nowhere, so collinear columns give the statistic of those that tell something."""
    need(df, *columns)
    k = len(columns)
    if not 2 <= k <= 15:
        raise ValueError("2 to 15 columns")
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    whole = df.agg(*(F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(columns))).first()
    z = [(x[c] - F.lit(whole[f"m{i}"])) / F.lit(whole[f"s{i}"] or 1.0) for i, c in enumerate(columns)]
    mask = sum((x[c].isNotNull().cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(z)), *(F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs)).collect()  # a row a pattern
    patterns = []
    for r in sorted(found, key=lambda r: r["mask"]):
        have = [i for i in range(k) if r["mask"] >> i & 1]
        if have:
            patterns.append((r["n"], have, [i for i in range(k) if i not in have], np.array([r[f"m{i}"] for i in have]), _square(r, "c", k)[np.ix_(have, have)]))
    n, centre, covariance = sum(p[0] for p in patterns), np.zeros(k), np.eye(k)
    inverse = lambda a: np.linalg.pinv(a, rcond=1e-7, hermitian=True)
    for _ in range(steps):
        parts = []
        for m, have, gone, mean, spread in patterns:
            slope = covariance[np.ix_(gone, have)] @ inverse(covariance[np.ix_(have, have)])
            own, around = np.zeros(k), np.zeros((k, k))
            own[have], own[gone] = mean, centre[gone] + slope @ (mean - centre[have])
            around[np.ix_(have, have)] = spread
            around[np.ix_(gone, have)] = slope @ spread
            around[np.ix_(have, gone)] = (slope @ spread).T
            around[np.ix_(gone, gone)] = covariance[np.ix_(gone, gone)] - slope @ covariance[np.ix_(have, gone)] + slope @ spread @ slope.T
            parts.append((m / n, own, around))
        new = sum((w * own for w, own, _ in parts), np.zeros(k))
        next_ = sum((w * (around + np.outer(own - new, own - new)) for w, own, around in parts), np.zeros((k, k)))
        moved = max(np.abs(new - centre).max(), np.abs(next_ - covariance).max()) if patterns else 0.0
        centre, covariance = new, next_
        if moved < 1e-12:
            break
    rank = lambda a: int(np.linalg.matrix_rank(a, tol=1e-7 * max(np.abs(a).max(), 1e-300), hermitian=True))
    chi2 = sum(m * float((mean - centre[have]) @ inverse(covariance[np.ix_(have, have)]) @ (mean - centre[have])) for m, have, _, mean, _ in patterns)
    free = sum(rank(covariance[np.ix_(p[1], p[1])]) for p in patterns) - rank(covariance) if patterns else 0
    p = dist.chi2_sf(max(0.0, chi2), free) if free > 0 else None
    return df.sparkSession.createDataFrame([(float(chi2), free, p, len(found))], "chi2 double, df long, p double, patterns long")
