"""Tests beyond plain association: Kendall, Fisher, normality, bootstrap, subgroups, screening, power."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import distributions as dist
from cohortlake.functions.columns import chi_square_sf, f_sf, fisher_p, two_sided_t
from cohortlake.operators.longform import long, moments, need, saved
from cohortlake.operators.order import dominated


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, tau (b) of complete rows, which collapse to cells of equal values first; agreeing pairs are counted by ``order.dominated``."""
    need(df, a, b)
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("NOT isnan(a) AND NOT isnan(b)").dropna()
    cells = saved(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    left, right = (cells.groupBy(c).agg(F.sum("c").alias("s")).agg(pairs("s").alias(f"t{c}")) for c in "ab")
    agree = dominated(cells, ["a"], "b", "c", "c").select(F.col("total").cast("double").alias("agree"))
    whole = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), pairs("c").alias("both")).crossJoin(left).crossJoin(right).crossJoin(agree)  # one row each
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    differ = every - F.col("ta") - F.col("tb") + F.col("both") - F.col("agree")
    return whole.select("n", ((F.col("agree") - differ) / F.nullif(F.sqrt((every - F.col("ta")) * (every - F.col("tb"))), F.lit(0.0))).alias("tau"))


def fisher(df: DataFrame, a: str, b: str) -> DataFrame:
    """n11, n10, n01, n00, min_expected, p (two-sided, exact) of two 0/1 columns over complete rows."""
    x, y = F.col(a).cast("int"), F.col(b).cast("int")
    count = lambda i, j: F.count_if((x == i) & (y == j))
    t = df.agg(*(count(i, j).alias(f"n{i}{j}") for i in (1, 0) for j in (1, 0)))
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    low = F.least(F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00")) * F.least(F.col("n11") + F.col("n01"), F.col("n10") + F.col("n00")) / F.nullif(n, F.lit(0))
    return t.select("*", low.alias("min_expected"), fisher_p("n11", "n10", "n01", "n00").alias("p"))


def _shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (1995), 3 to 5,000 values."""
    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(ss)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
        ends = [last]
        if n > 5:
            ends.append(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u))
        k = len(ends)
        phi = (ss - 2 * float(m[-k:] @ m[-k:])) / (1 - 2 * sum(e * e for e in ends))
        a = m / math.sqrt(phi)
        for i, e in enumerate(ends):
            a[-1 - i], a[i] = e, -e
    spread = float(((x - x.mean()) ** 2).sum())
    if spread == 0:
        return 1.0, 1.0
    w = min(float(a @ x) ** 2 / spread, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return w, 1.0
    if n <= 11:
        edge = 0.459 * n - 2.273
        if edge <= math.log(1 - w):
            return w, 0.0
        z = -math.log(edge - math.log(1 - w))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        z, ln = math.log(1 - w), math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, dist.normal_sf((z - mean) / sd)


def shapiro(df: DataFrame, columns: list[str], most: int = 5000) -> DataFrame:
    """variable, n, w, p of columns with 3 to ``most`` values; larger ones are left to ``dagostino``, so no group is
    larger than ``most``."""
    rows = long(df, columns).filter("value IS NOT NULL")
    sizes = rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(3, most))

    def test(part: pd.DataFrame) -> pd.DataFrame:
        w, p = _shapiro(part["value"].to_numpy(float))
        return pd.DataFrame([(part["variable"].iloc[0], len(part), w, p)], columns=["variable", "n", "w", "p"])

    return rows.join(F.broadcast(sizes.select("variable")), "variable").groupBy("variable").applyInPandas(test, "variable string, n long, w double, p double")


def dagostino(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, z_skew, z_kurt, k2, p of columns with 20 values or more: moments in one pass."""
    m = long(df, columns).groupBy("variable").agg(F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).filter("n >= 20 AND g1 IS NOT NULL")
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    x = (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    below = 1 + x * F.sqrt(2 / (a - 4))
    kurt = (1 - 2 / (9 * a) - F.signum(below) * F.cbrt((1 - 2 / a) / F.abs(below))) / F.sqrt(2 / (9 * a))
    out = m.select("variable", "n", skew.alias("z_skew"), kurt.alias("z_kurt"))
    k2 = F.col("z_skew") ** 2 + F.col("z_kurt") ** 2
    return out.withColumn("k2", k2).withColumn("p", F.exp(-F.col("k2") / 2))


def normality(df: DataFrame, columns: list[str], most: int = 5000) -> DataFrame:
    """variable, n, test, w, k2, p of every column: Shapiro-Wilk up to ``most`` values, D'Agostino's K2 beyond. With
    fewer than 3 values, or K2 of a constant, nothing is tested and the results are null."""
    sizes = long(df, columns).groupBy("variable").agg(F.count("value").alias("n"))
    w = shapiro(df, columns, most).select("variable", "w", F.col("p").alias("pw"))
    k = dagostino(df, columns).filter(F.col("n") > most).select("variable", "k2", F.col("p").alias("pk"))
    test = F.when(F.col("n") > most, "dagostino").when(F.col("n") >= 3, "shapiro")
    return sizes.join(w, "variable", "left").join(k, "variable", "left").select("variable", "n", test.alias("test"), "w", "k2", F.coalesce("pw", "pk").alias("p"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn_sums(batches, replicates: int):
    """(side, r, n, s, q) of a partition: for each arm and replicate, the sums of weights, weighted values and squares."""
    cuts = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)]) * 2.0**32).astype(np.uint32)
    # the weight by the first 16 bits, but where a cut falls within them
    low = np.searchsorted(cuts, np.arange(1 << 16, dtype=np.uint32) << np.uint32(16), "right").astype(np.uint8)
    high = np.searchsorted(cuts, (np.arange(1 << 16, dtype=np.uint32) << np.uint32(16)) | np.uint32(0xFFFF), "right").astype(np.uint8)
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros((2, replicates, 3))
    for batch in batches:
        first, h, v = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        for side in (0, 1):
            own = np.flatnonzero(first == (side == 0))
            for i in range(0, len(own), 1024):
                at = own[i : i + 1024]
                u = (_mixed(h[at][None, :] + steps[:, None]) >> np.uint64(32)).astype(np.uint32)
                top = u >> np.uint32(16)
                weight = low[top]
                split = np.nonzero(weight != high[top])
                weight[split] = np.searchsorted(cuts, u[split], "right")
                sums[side] += weight.astype(float) @ np.stack([np.ones(len(at)), v[at], v[at] ** 2], 1)
    side, r = np.repeat([0, 1], replicates), np.tile(np.arange(1, replicates + 1), 2)
    yield pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(r, pa.int32()), *(pa.array(sums[:, :, k].ravel()) for k in range(3))], ["side", "r", "n", "s", "q"])


def bootstrap_difference(df: DataFrame, key: str, value: str, arm: str, a, b, replicates: int = 1000, most: int | None = None) -> DataFrame:
    """n, d (standardised difference a - b), low, high: 95 % percentile interval of a Poisson bootstrap, whose weights are
    a hash of key and replicate, so reruns agree. One pass sums all replicates within each partition. Beyond ``most``
    rows, if given, the interval is null; d never is for that."""
    rows = df.filter(F.col(arm).isin(a, b) & F.col(value).isNotNull()).select(F.col(key).alias("k"), (F.col(arm) == a).alias("first"), F.col(value).cast("double").alias("v"))
    part = lambda c, name: [F.count_if(c).alias(f"n{name}"), F.avg(F.when(c, F.col("v"))).alias(f"m{name}"), F.coalesce(F.var_pop(F.when(c, F.col("v"))) * F.count_if(c), F.lit(0.0)).alias(f"w{name}")]
    m = rows.agg(F.count(F.lit(1)).alias("n"), *part(F.col("first"), "a"), *part(~F.col("first"), "b"))
    standard = lambda gap, within, free: gap / F.nullif(F.sqrt(within / F.nullif(free, F.lit(0))), F.lit(0.0))
    whole = m.select("n", standard(F.col("ma") - F.col("mb"), F.col("wa") + F.col("wb"), F.col("na") + F.col("nb") - 2).alias("d"))
    # about the mean, so that squares do not cancel
    centre = rows.agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n"))
    moved = rows.crossJoin(F.broadcast(centre))  # centre is one row
    moved = moved if most is None else moved.filter(F.col("n") <= most)
    moved = moved.select("first", F.xxhash64("k").alias("h"), (F.col("v") - F.col("c")).alias("v"))
    sums = moved.mapInArrow(lambda batches: _drawn_sums(batches, replicates), "side int, r int, n double, s double, q double")
    of = lambda c, side: F.sum(F.when(F.col("side") == side, F.col(c))).alias(f"{c}{side}")
    sums = sums.groupBy("r").agg(*(of(c, side) for c in "nsq" for side in (0, 1)))
    n0, n1 = (F.nullif(F.col(f"n{side}"), F.lit(0.0)) for side in (0, 1))
    within = F.col("q0") - F.col("s0") ** 2 / n0 + F.col("q1") - F.col("s1") ** 2 / n1
    drawn = sums.select(standard(F.col("s0") / n0 - F.col("s1") / n1, F.greatest(within, F.lit(0.0)), n0 + n1 - 2).alias("d"))
    ends = drawn.agg(F.percentile("d", [0.025, 0.975]).alias("e"))  # one value a replicate
    return whole.crossJoin(ends).select("n", "d", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))  # one row each


def subgroups(df: DataFrame, outcome: str, arm: str, columns: list[str], a, b) -> DataFrame:
    """subgroup, level, n_a, n_b, diff (a - b), t, df, p (Welch), cohens_d, few (fewer than 5 in an arm); null levels are
    left out. All subgroup columns share one pass."""
    need(df, outcome, arm, *columns)
    rows = df.filter(F.col(arm).isin(a, b)).select(arm, outcome, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot([arm, outcome], columns, "subgroup", "level").filter("level IS NOT NULL")
    m = moments(rows, [outcome], ["subgroup", "level", arm]).groupBy("subgroup", "level").agg(*(F.max(F.when(F.col(arm) == g, F.col(c))).alias(f"{c}_{k}") for k, g in (("a", a), ("b", b)) for c in ("n", "mean", "var")))
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    ea, eb, diff = va / na, vb / nb, F.col("mean_a") - F.col("mean_b")
    free = (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))
    t = diff / F.nullif(F.sqrt(ea + eb), F.lit(0.0))
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    return m.select("subgroup", "level", "n_a", "n_b", diff.alias("diff"), t.alias("t"), free.alias("df"), two_sided_t(t, free).alias("p"), (diff / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"), (F.least(na, nb) < 5).alias("few"))


def subgroup_odds(df: DataFrame, outcome: str, arm: str, columns: list[str], a, b) -> DataFrame:
    """subgroup, level, n_a, n_b, rate_a, rate_b, chi2 (no continuity), p, odds_ratio (a to b, 0.5 added where a cell is empty), low, high
    (Woolf, 95 %), few, of a 0/1 outcome at every level of every column, in one pass."""
    need(df, outcome, arm, *columns)
    rows = df.filter(F.col(arm).isin(a, b) & F.col(outcome).isin(0, 1)).select((F.col(arm) == a).alias("_a"), F.col(outcome).cast("int").alias("_y"), *(F.col(c).cast("string").alias(c) for c in columns))
    rows = rows.unpivot(["_a", "_y"], columns, "subgroup", "level").filter("level IS NOT NULL")
    count = lambda first, y: F.count_if((F.col("_a") == first) & (F.col("_y") == y)).cast("double")
    m = rows.groupBy("subgroup", "level").agg(count(True, 1).alias("a1"), count(True, 0).alias("a0"), count(False, 1).alias("b1"), count(False, 0).alias("b0"))
    a1, a0, b1, b0 = (F.col(c) for c in ("a1", "a0", "b1", "b0"))
    na, nb = a1 + a0, b1 + b0
    chi2 = (na + nb) * (a1 * b0 - a0 * b1) ** 2 / F.nullif(na * nb * (a1 + b1) * (a0 + b0), F.lit(0.0))
    h = F.when(F.least(a1, a0, b1, b0) == 0, 0.5).otherwise(0.0)
    odds = (a1 + h) * (b0 + h) / ((a0 + h) * (b1 + h))
    se = F.sqrt(1 / (a1 + h) + 1 / (a0 + h) + 1 / (b1 + h) + 1 / (b0 + h))
    z, none = NormalDist().inv_cdf(0.975), F.lit(0.0)
    return m.select(
        "subgroup", "level", na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), (a1 / F.nullif(na, none)).alias("rate_a"), (b1 / F.nullif(nb, none)).alias("rate_b"), chi2.alias("chi2"),
        chi_square_sf(chi2, F.lit(1)).alias("p"), odds.alias("odds_ratio"), F.exp(F.log(odds) - z * se).alias("low"), F.exp(F.log(odds) + z * se).alias("high"), (F.least(na, nb) < 5).alias("few"),
    )


def interaction(df: DataFrame, outcome: str, arm: str, factor: str, a=None, b=None) -> DataFrame:
    """f, df1, df2, p of arm x factor for two arms (a and b, or the first two in order).

    Within a level that has both arms the difference of means weighs n_a n_b / (n_a + n_b); what these differences vary about their
    common mean is what the additive model leaves, so the levels, however many, are summed by Spark.
    """
    need(df, outcome, arm, factor)
    if a is None:
        a, b = (r[0] for r in df.select(arm).filter(F.col(arm).isNotNull()).distinct().orderBy(arm).limit(2).collect())
    rows = df.filter(F.col(arm).isin(a, b)).select((F.col(arm) == a).alias("a"), F.col(factor).alias("b"), F.col(outcome).cast("double").alias("y")).dropna()
    part = lambda first: F.when(F.col("a") == first, F.col("y"))
    n = {k: F.count(part(k)) for k in (True, False)}
    within = sum((F.coalesce(F.var_pop(part(k)) * n[k], F.lit(0.0)) for k in (True, False)), F.lit(0.0))
    levels = rows.groupBy("b").agg(n[True].alias("na"), n[False].alias("nb"), (F.avg(part(True)) - F.avg(part(False))).alias("d"), within.alias("within"))
    w = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    s = levels.agg(
        (F.sum(w * F.col("d") ** 2) - F.sum(w * F.col("d")) ** 2 / F.nullif(F.sum(F.when(F.col("d").isNotNull(), w)), F.lit(0.0))).alias("between"), F.sum("within").alias("within"), (F.count("d") - 1).alias("df1"),
        (F.sum(F.col("na") + F.col("nb")) - F.sum((F.col("na") > 0).cast("int") + (F.col("nb") > 0).cast("int"))).alias("df2"),
    )
    f = F.when((F.col("df1") > 0) & (F.col("df2") > 0), F.col("between") / F.col("df1") / F.nullif(F.col("within") / F.col("df2"), F.lit(0.0)))
    return s.select(f.alias("f"), "df1", "df2", f_sf(f, "df1", "df2").alias("p"))


def binary_interaction(df: DataFrame, outcome: str, arm: str, factor: str, steps: int = 50, tol: float = 1e-9) -> DataFrame:
    """lr, df, p, levels, cells of arm x factor for a 0/1 outcome: the likelihood-ratio test of a logit with arm, factor and their interaction
    against one with arm and factor, over complete rows.

    The full model fits each cell's own rate. The smaller one is fitted on counts of cells by Newton steps: levels, however many, meet
    only themselves in its matrix, so each step sums over levels, in Spark, what remains for the arms (a Schur complement, arms by
    arms), and then moves each level by itself. Levels whose outcomes are all alike fit both models alike and are left out; df is the cells
    less levels and arms, plus one.
    """
    need(df, outcome, arm, factor)
    rows = df.select(F.col(arm).alias("a"), F.col(factor).alias("l"), F.col(outcome).cast("int").alias("y")).filter("y IN (0, 1)").dropna()
    cells = rows.groupBy("l", "a").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").cast("double").alias("y"))
    arms = sorted(r.a for r in cells.select("a").distinct().limit(51).collect())
    if not 2 <= len(arms) <= 50:
        raise ValueError("2 to 50 arms are needed")
    of = lambda c, a: F.coalesce(F.sum(F.when(F.col("a") == a, F.col(c))), F.lit(0.0))
    k = len(arms)
    table = cells.groupBy("l").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), *(of("n", a).alias(f"n{i}") for i, a in enumerate(arms)), *(of("y", a).alias(f"y{i}") for i, a in enumerate(arms))).filter("y > 0 AND y < n")
    table = saved(table.withColumn("alpha", F.log((F.col("y") + 0.5) / (F.col("n") - F.col("y") + 0.5))))
    xlogx = lambda part, whole: F.when(part > 0, part * F.log(part / whole)).otherwise(0.0)
    full = sum((xlogx(F.col(f"y{i}"), F.col(f"n{i}")) + xlogx(F.col(f"n{i}") - F.col(f"y{i}"), F.col(f"n{i}")) for i in range(k)), F.lit(0.0))
    whole = table.agg(F.sum(full).alias("full"), F.count(F.lit(1)).alias("levels"), F.coalesce(F.sum(sum(((F.col(f"n{i}") > 0).cast("int") for i in range(k)), F.lit(0))), F.lit(0)).alias("cells"), *(F.max(F.col(f"n{i}")).alias(f"m{i}") for i in range(k))).first()
    kind = "lr double, df long, p double, levels long, cells long"
    used = sum(1 for i in range(k) if whole[f"m{i}"])
    free = whole.cells - whole.levels - used + 1
    if whole.levels < 2 or free < 1:
        return df.sparkSession.createDataFrame([(None, max(0, free), None, whole.levels, whole.cells)], kind)
    beta = np.zeros(k)  # the first arm is the reference
    for _ in range(steps):
        eta = [F.col("alpha") + float(b) for b in beta]
        p = [1 / (1 + F.exp(-e)) for e in eta]
        w = [F.col(f"n{i}") * p[i] * (1 - p[i]) for i in range(k)]
        r = [F.col(f"y{i}") - F.col(f"n{i}") * p[i] for i in range(k)]
        seen = table.select("*", *(x.alias(f"w{i}") for i, x in enumerate(w)), *(x.alias(f"r{i}") for i, x in enumerate(r)), *(F.log1p(F.exp(-F.abs(e))).alias(f"s{i}") for i, e in enumerate(eta)), *(e.alias(f"e{i}") for i, e in enumerate(eta)))
        like = sum((F.col(f"y{i}") * F.col(f"e{i}") - F.col(f"n{i}") * (F.greatest(F.col(f"e{i}"), F.lit(0.0)) + F.col(f"s{i}")) for i in range(k)), F.lit(0.0))
        seen = seen.withColumn("d", sum((F.col(f"w{i}") for i in range(k)), F.lit(0.0))).withColumn("g", sum((F.col(f"r{i}") for i in range(k)), F.lit(0.0)))
        pairs = [(i, j) for i in range(1, k) for j in range(i, k)]
        s = seen.agg(F.sum(like).alias("like"), F.max(F.abs("g")).alias("worst"), *(F.sum(F.col(f"r{i}")).alias(f"u{i}") for i in range(1, k)), *((F.sum((F.col(f"w{i}") if i == j else F.lit(0.0)) - F.col(f"w{i}") * F.col(f"w{j}") / F.col("d"))).alias(f"h{i}_{j}") for i, j in pairs), *((F.sum(F.col(f"r{i}") - F.col(f"w{i}") * F.col("g") / F.col("d"))).alias(f"t{i}") for i in range(1, k))).first()
        if max(s["worst"], *(abs(s[f"u{i}"]) for i in range(1, k))) < tol * max(1.0, abs(s["like"])) ** 0.5:
            break
        h = np.zeros((k - 1, k - 1))
        for i, j in pairs:
            h[i - 1, j - 1] = h[j - 1, i - 1] = s[f"h{i}_{j}"]
        step = np.clip(np.concatenate([[0.0], np.linalg.pinv(h) @ np.array([s[f"t{i}"] for i in range(1, k)])]), -5, 5)
        move = (F.col("g") - sum((F.col(f"w{i}") * float(step[i]) for i in range(k)), F.lit(0.0))) / F.col("d")
        table = saved(seen.withColumn("alpha", F.col("alpha") + F.greatest(F.least(move, F.lit(5.0)), F.lit(-5.0))).select(*table.columns))
        beta = beta + step
    else:
        raise ValueError("no convergence: an arm's outcomes may all be alike")
    lr = max(0.0, 2 * (whole.full - s["like"]))
    return df.sparkSession.createDataFrame([(lr, free, dist.chi2_sf(lr, free), whole.levels, whole.cells)], kind)


def screen(df: DataFrame, event: str, columns: list[str]) -> DataFrame:
    """variable, n_a, n_b, t, p, cohens_d (event less non-event) of each numeric predictor of a 0/1 event, in one pass."""
    m = moments(df.filter(F.col(event).isin(0, 1)), columns, [event]).groupBy("variable").agg(*(F.max(F.when(F.col(event) == g, F.col(c))).alias(f"{c}_{k}") for k, g in (("a", 1), ("b", 0)) for c in ("n", "mean", "var")))
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    ea, eb, diff = va / na, vb / nb, F.col("mean_a") - F.col("mean_b")
    free = (ea + eb) ** 2 / (ea**2 / (na - 1) + eb**2 / (nb - 1))
    t = diff / F.nullif(F.sqrt(ea + eb), F.lit(0.0))
    return m.select("variable", "n_a", "n_b", t.alias("t"), two_sided_t(t, free).alias("p"), (diff / F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))).alias("cohens_d"))


def power(findings: DataFrame, effect: str, n1: str, n2: str, alpha: float = 0.05) -> DataFrame:
    """Adds power of a two-sided two-sample t test for a standardised effect, and class: well (0.8), moderate (0.6), low."""

    @F.pandas_udf("double")
    def achieved(d: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dist.t_test_power(x, i, j, alpha) for x, i, j in zip(d, a, b)], dtype=float)

    out = findings.withColumn("power", F.nanvl(achieved(F.col(effect).cast("double"), F.col(n1).cast("double"), F.col(n2).cast("double")), F.lit(None).cast("double")))
    return out.withColumn("power_class", F.when(F.col("power") >= 0.8, "well").when(F.col("power") >= 0.6, "moderate").when(F.col("power").isNotNull(), "low"))


def sample_sizes(findings: DataFrame, effect: str, alpha: float = 0.05, kind: str = "two-sample") -> DataFrame:
    """Adds n_80 and n_90: rows (a group, if two) for a power of 80 and 90 % at each standardised effect; kind is two-sample, one-sample or paired."""
    if kind not in ("two-sample", "one-sample", "paired"):
        raise ValueError("kind is two-sample, one-sample or paired")

    def size(wanted: float):
        @F.pandas_udf("long")
        def rows(d: pd.Series) -> pd.Series:
            return pd.Series([dist.t_test_size(x, wanted, alpha, kind) for x in d], dtype="Int64")

        return rows(F.col(effect).cast("double"))

    return findings.withColumn("n_80", size(0.8)).withColumn("n_90", size(0.9))
