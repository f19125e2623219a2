"""Tests of association from small sufficient statistics; p-values by ``functions.distributions``."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.columns import chi_square_sf, two_sided_normal, two_sided_t
from cohortlake.operators.longform import correlation, moments, need, ranged, ranks, ranks_of
from cohortlake.operators.order import Ranges


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r over pairwise complete rows, all pairs in one aggregate."""
    need(df, *columns)
    pairs = list(combinations(columns, 2))
    x = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(x[a].isNotNull() & x[b].isNotNull()).alias("n"), correlation(x[a], x[b]).alias("r")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.col(f"p{k}") for k in range(len(pairs))))))


def correlation_tests(df: DataFrame, columns: list[str]) -> DataFrame:
    """As ``correlations``, with the two-sided p of each r by t on n - 2 degrees of freedom."""
    free = F.col("n") - 2
    t = F.col("r") * F.sqrt(free / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return correlations(df, columns).withColumn("p", F.when(free > 0, F.when(F.abs("r") >= 1, 0.0).otherwise(two_sided_t(t, free))))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho: Pearson's correlation of average ranks over complete rows, which collapse to cells of equal values first."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    cells = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    ranked = cells.join(ranks_of(cells, "a", "k", "x"), "a").join(ranks_of(cells, "b", "k", "y"), "b")
    # about the middle rank, so that sums of squares do not cancel
    middle = cells.agg(((F.sum("k") + 1) / 2).alias("middle"))
    ranked = ranked.crossJoin(F.broadcast(middle)).withColumn("x", F.col("x") - F.col("middle")).withColumn("y", F.col("y") - F.col("middle"))  # one row
    s = lambda c: F.sum(F.col("k") * c)
    x, y = F.col("x"), F.col("y")
    return ranked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), (s(x * y) / F.nullif(F.sqrt(s(x * x) * s(y * y)), F.lit(0.0))).alias("rho"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, chi2 (Yates on 2 x 2), df, min_expected, cramers_v, its magnitude (0.1, 0.3, 0.5) and p of two categorical columns.
    Only cells that occur are visited: an empty one adds its expected number, and those are what the others leave of n."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, columns = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    whole = cells.agg(F.sum("o").alias("n")).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("r"), F.min("ra").alias("ra_least"))))
    whole = whole.crossJoin(F.broadcast(columns.agg(F.count(F.lit(1)).alias("c"), F.min("cb").alias("cb_least"))))  # each one row
    full = cells.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(whole)).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    gap = F.abs(F.col("o") - F.col("e"))
    small = (F.col("r") == 2) & (F.col("c") == 2)
    yates = F.when(small, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    # an empty cell adds its e, and all e add up to n
    out = full.groupBy("n", "r", "c", "ra_least", "cb_least").agg(F.sum(yates * yates / F.col("e")).alias("seen"), F.sum("e").alias("es"), F.count(F.lit(1)).alias("cells"), F.min("e").alias("e_seen"))
    lone = F.col("n") - F.col("es")  # in a 2 x 2 table the empty cells, one or a diagonal, have one and the same e
    each = lone / F.nullif(4 - F.col("cells"), F.lit(0))
    rest = F.when(small, lone * (1 - F.least(F.lit(0.5), each) / F.nullif(each, F.lit(0.0))) ** 2).otherwise(lone)
    out = out.withColumn("chi2", F.col("seen") + F.when(F.col("cells") < F.col("r") * F.col("c"), F.coalesce(rest, F.lit(0.0))).otherwise(0.0))
    least = F.col("ra_least") * F.col("cb_least") / F.col("n")  # of all cells, empty ones too
    v = F.sqrt(F.col("chi2") / F.nullif(F.col("n") * (F.least("r", "c") - 1), F.lit(0)))
    free = (F.col("r") - 1) * (F.col("c") - 1)
    strength = F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")
    return out.select("n", "chi2", free.alias("df"), least.alias("min_expected"), v.alias("cramers_v"), strength.alias("magnitude"), chi_square_sf("chi2", free).alias("p"))


def _two(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """One row: n, mean, var of the value in groups a and b."""
    m = moments(df.filter(F.col(group).isin(a, b)), [value], [group])
    return m.agg(*(F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}_{k}") for k, g in (("a", a), ("b", b)) for c in ("n", "mean", "var")))


def magnitude(d, small: float, medium: float, large: float) -> F.Column:
    x = F.abs(d)
    return F.when(x < small, "negligible").when(x < medium, "small").when(x < large, "medium").when(x >= large, "large")


def welch(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """n_a, n_b, mean_a, mean_b, t, df, cohens_d (pooled, a less b), its magnitude (0.2, 0.5, 0.8) and p."""
    s = _two(df, value, group, a, b)
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(ea + eb)
    free = (ea + eb) ** 2 / (ea**2 / (F.col("n_a") - 1) + eb**2 / (F.col("n_b") - 1))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return s.select("n_a", "n_b", "mean_a", "mean_b", t.alias("t"), free.alias("df"), ((F.col("mean_a") - F.col("mean_b")) / pooled).alias("cohens_d"), magnitude((F.col("mean_a") - F.col("mean_b")) / pooled, 0.2, 0.5, 0.8).alias("magnitude"), two_sided_t(t, free).alias("p"))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, ranks (sum of average ranks over all groups), with ties (sum of t^3 - t) and total on every row."""
    rows = df.select(F.col(value).cast("double").alias("value"), F.col(group).alias("g")).dropna()
    r = ranks(rows, "value")
    cells = rows.groupBy("value", "g").agg(F.count(F.lit(1)).alias("k")).join(r, "value")
    sums = cells.groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("ranks"))
    ties = r.agg(F.sum(F.col("c") ** 3 - F.col("c")).alias("ties"), F.sum("c").alias("total"))
    return sums.crossJoin(F.broadcast(ties)).withColumnRenamed("g", "group")


def rank_test(na, nb, ra, ties, n) -> tuple[F.Column, F.Column, F.Column]:
    """(u of a, z with ties and continuity, Cliff's delta) from the rank sum of a."""
    u = ra - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
    gap = u - na * nb / 2
    return u, F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0)), 2 * u / (na * nb) - 1


def mann_whitney(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """n_a, n_b, u (of a), z (tie-corrected, continuity 0.5), p (normal), cliffs_delta (exact, from ranks), its magnitude
    (0.147, 0.33, 0.474). For groups of 8 at most without ties use ``exact_mann_whitney_p``."""
    s = rank_sums(df.filter(F.col(group).isin(a, b)), value, group).agg(
        F.max(F.when(F.col("group") == a, F.col("n"))).alias("n_a"), F.max(F.when(F.col("group") == b, F.col("n"))).alias("n_b"), F.max(F.when(F.col("group") == a, F.col("ranks"))).alias("ra"), F.max("ties").alias("ties"), F.max("total").alias("n"))
    na, nb, n = F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("n").cast("double")
    u, z, delta = rank_test(na, nb, F.col("ra"), F.col("ties"), n)
    return s.select("n_a", "n_b", u.alias("u"), z.alias("z"), two_sided_normal(z).alias("p"), delta.alias("cliffs_delta"), magnitude(delta, 0.147, 0.33, 0.474).alias("magnitude"))


def exact_mann_whitney_p(u: float, na: int, nb: int) -> float:
    """Two-sided p of u without ties, from the number of rank sets that give each u."""
    ways = [[1] + [0] * (na * nb) for _ in range(na + 1)]
    for i in range(1, na + 1):
        ways[i] = [0] * (na * nb + 1)
    for value in range(1, na + nb + 1):  # rank ``value`` joins the first group or not
        for i in range(min(na, value), 0, -1):
            shift = value - i
            for x in range(na * nb, shift - 1, -1):
                ways[i][x] += ways[i - 1][x - shift]
    low = min(u, na * nb - u)
    return min(1.0, 2 * sum(ways[na][: int(low) + 1]) / sum(ways[na]))


def pairwise(df: DataFrame, value: str, group: str) -> DataFrame:
    """a, b (a before b), n_a, n_b, u, z, p, p_adjusted (Bonferroni over the pairs): Mann-Whitney tests of all pairs of groups of 2
    rows at least. Pairs of groups meet by value on their value counts, never by row; the groups are few, as a family of tests is."""
    rows = df.select(F.col(value).cast("double").alias("value"), F.col(group).alias("g")).dropna()
    counts = rows.groupBy("value", "g").agg(F.count(F.lit(1)).alias("k"))
    groups = counts.groupBy("g").agg(F.sum("k").alias("n")).filter("n > 1")
    names = sorted(r.g for r in groups.select("g").limit(501).collect())
    if len(names) > 500:
        raise ValueError("more than 500 groups: their pairs are no family of tests any more")
    pairs = df.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(combinations(names, 2))] or [], f"pair int, a {rows.schema['g'].dataType.simpleString()}, b {rows.schema['g'].dataType.simpleString()}")
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.col("a").alias("g"), F.lit(1).alias("first")), F.struct(F.col("b").alias("g"), F.lit(0).alias("first")))).alias("s")).select("pair", "s.*")
    cells = counts.join(F.broadcast(sides), "g").groupBy("pair", "value").agg(F.sum(F.col("k") * F.col("first")).alias("ka"), F.sum("k").alias("c"))
    ranked = ranged(cells, ["pair"]).withColumn("rank", F.col("upto") - (F.col("c") - 1) / 2)
    s = ranked.groupBy("pair").agg(F.sum("ka").alias("n_a"), (F.sum("c") - F.sum("ka")).alias("n_b"), F.sum(F.col("ka") * F.col("rank")).alias("ra"), F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties"), F.sum("c").cast("double").alias("n"))
    u, z, _ = rank_test(F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("ra"), F.col("ties"), F.col("n"))
    out = pairs.join(s, "pair").select("a", "b", "n_a", "n_b", u.alias("u"), z.alias("z"), two_sided_normal(z).alias("p"))
    return out.withColumn("p_adjusted", F.least(F.col("p") * max(1, len(names) * (len(names) - 1) // 2), F.lit(1.0)))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """groups, n, h (tie-corrected), p."""
    s = rank_sums(df, value, group)
    n = F.max("total").cast("double")
    h = (12 / (n * (n + 1)) * F.sum(F.col("ranks") ** 2 / F.col("n")) - 3 * (n + 1)) / (1 - F.max("ties") / (n**3 - n))
    return s.agg(F.count(F.lit(1)).alias("groups"), F.max("total").alias("n"), h.alias("h")).withColumn("p", chi_square_sf("h", (F.col("groups") - 1).cast("double")))


def risk(df: DataFrame, outcome: str, arm: str, a, b) -> DataFrame:
    """Risk difference, risk ratio, odds ratio and number needed to treat of a 0/1 outcome in arms a and b."""
    s = df.agg(F.avg(F.when(F.col(arm) == a, F.col(outcome).cast("double"))).alias("p1"), F.avg(F.when(F.col(arm) == b, F.col(outcome).cast("double"))).alias("p2"))
    p1, p2, zero = F.col("p1"), F.col("p2"), F.lit(0.0)
    odds = p1 / F.nullif(1 - p1, zero) / F.nullif(p2 / F.nullif(1 - p2, zero), zero)
    return s.select((p1 - p2).alias("rd"), (p1 / F.nullif(p2, zero)).alias("rr"), odds.alias("odds_ratio"), (1 / F.nullif(F.abs(p1 - p2), zero)).alias("nnt"))


def adjust(df: DataFrame, p: str, key: str, family: list[str]) -> DataFrame:
    """Adds bonferroni, bh and holm adjusted p-values within each family; ties of p by key, rows without p have none and count nothing.

    Ranks, Holm's running maximum and the running minimum of Benjamini and Hochberg are running sums over ranges of (family, p),
    so a family may be of any size.
    """
    ranges = Ranges(df.filter(F.col(p).isNotNull()), family, [p, key])
    names = [f"_f{i}" for i in range(len(family))]
    whole = ranges.rows.groupBy(*(F.col(c).alias(n) for c, n in zip(family, names))).agg(F.count(F.lit(1)).alias("m"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(family, names)], F.lit(True))
    ranked = ranges.running(ranges.rows.withColumn("_one", F.lit(1)), rk=("sum", "_one")).join(whole, same).drop("_one", *names)
    step = ranked.withColumn("_up", F.least(F.col(p) * (F.col("m") - F.col("rk") + 1), F.lit(1.0))).withColumn("_down", F.least(F.col(p) * F.col("m") / F.col("rk"), F.lit(1.0)))
    out = ranges.running(ranges.running(step, holm=("max", "_up")), reverse=True, bh=("min", "_down"))
    out = out.select(*df.columns, F.least(F.col(p) * F.col("m"), F.lit(1.0)).alias("bonferroni"), "bh", "holm")
    none = F.lit(None).cast("double")
    return out.unionByName(df.filter(F.col(p).isNull()).select("*", *(none.alias(c) for c in ("bonferroni", "bh", "holm"))))


def gate(df: DataFrame, p: str, key: str, primary: str, study: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds adjusted and gated_out: Bonferroni on primary endpoints; secondary ones get BH if any primary is below
    alpha, else none."""
    tested = adjust(df, p, key, [*study, primary])
    names = [f"_s{i}" for i in range(len(study))]
    won = tested.groupBy(*(F.col(c).alias(n) for c, n in zip(study, names))).agg(F.max(F.when(F.col(primary) & (F.col("bonferroni") < alpha), True).otherwise(False)).alias("won"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(study, names)], F.lit(True))
    tested = tested.join(won, same)
    return tested.withColumn("adjusted", F.when(F.col(primary), F.col("bonferroni")).when(F.col("won"), F.col("bh"))).withColumn("gated_out", ~F.col(primary) & ~F.col("won")).drop("won", "bonferroni", "bh", "holm", *names)
