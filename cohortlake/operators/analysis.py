"""The whole analysis of a trial table: integrity, tests by the kind of outcome, corrections; and the report of its tables.

What is analysed is derived from names and values unless it is given. Columns that are only averaged share one table of moments by
arm and event, from one pass, which balance, tests, effect sizes and screening fold as they need. Each step gives a tidy table;
steps that cannot run give none, and their reason stands in the table of steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.columns import chi_square_sf, two_sided_t
from cohortlake.operators import association as assoc
from cohortlake.operators import findings as tests
from cohortlake.operators import guardrails, inference, longform, longitudinal, models, profile, survival
from cohortlake.operators.guardrails import numeric_columns
from cohortlake.operators.longform import long, missing, saved
from cohortlake.operators.roles import levels, plain, roles

OUTCOMES = ("continuous", "binary", "survival", "longitudinal")
BALANCED, COVARIATES, TESTED, SUBGROUPS, MEANS_TEST = 20, 5, 5, 3, 30
#: Columns that miss this percentage of their values or more are never filled in: most of what is said of them would be made up.
FILLED = 50
FINDING = "finding string, endpoint string, endpoint_type string, test string, n long, n_a long, n_b long, effect_label string, effect double, low double, high double, statistic double, p double"


@dataclass(frozen=True)
class Plan:
    """What to analyse. ``derived`` fills in what is not given."""

    arm: str | None = None
    time: str | None = None
    event: str | None = None
    subject: str | None = None
    outcome: str | None = None
    primary: list[str] = field(default_factory=list)
    secondary: list[str] = field(default_factory=list)
    subgroups: list[str] = field(default_factory=list)
    alpha: float = 0.05

    def derived(self, df: DataFrame, seen: dict | None = None) -> Plan:
        """Arm, time and event by ``roles``. The outcome is survival with a time and an event, longitudinal with a time alone, else binary
        if every primary endpoint holds 0 and 1, else continuous. Endpoints are numbers in the order of columns: for survival the first 12,
        else 3 primary and 3 secondary ones. Subgroups are the first 3 columns that are no numbers and have 2 to 6 values."""
        seen = seen or levels(df)
        found = {} if self.arm and (self.event or self.primary) else roles(df)
        arm, time, event = self.arm or found.get("arm"), self.time or found.get("time"), self.event or found.get("event")
        numbers = [c for c in numeric_columns(df) if c not in (arm, time, event, self.subject)]
        outcome = self.outcome or ("survival" if time and event else "longitudinal" if time else None)
        primary = self.primary or numbers[: 12 if outcome == "survival" else 3]
        secondary = self.secondary or ([] if self.primary or outcome == "survival" else numbers[3:6])
        if outcome is None:
            outcome = "binary" if primary and all(seen[c][1] for c in primary) else "continuous"
        if outcome not in OUTCOMES:
            raise ValueError(f"outcome is one of {', '.join(OUTCOMES)}")
        words = [c for c in df.columns if c not in numeric_columns(df) and c not in (arm, time, event, self.subject) and 2 <= seen[c][0] <= 6]
        return replace(self, arm=arm, time=time, event=event, outcome=outcome, primary=primary, secondary=secondary, subgroups=self.subgroups or words[:SUBGROUPS])


def cube(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys..., variable, n, mean, m2 (squares about the mean): one pass, saved; ``folded`` adds groups up."""
    rows = long(df, columns, keys).filter("value IS NOT NULL")
    return saved(rows.groupBy(*keys, "variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2")))


def folded(moments: DataFrame, by: list[str]) -> DataFrame:
    """by..., variable, n, mean, var (n - 1) of a ``cube`` over its other keys."""
    keys = [*by, "variable"]
    whole = moments.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.sum("n").alias("n_"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean_"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    parts = moments.join(F.broadcast(whole), same).select(*keys, "n", "mean", "m2", "n_", "mean_")  # a row a column and group
    out = parts.groupBy(*keys, F.col("n_").alias("_n"), F.col("mean_").alias("_mean")).agg((F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - F.col("mean_")) ** 2)).alias("_m2"))
    return out.select(*keys, F.col("_n").alias("n"), F.col("_mean").alias("mean"), (F.col("_m2") / F.nullif(F.col("_n") - 1, F.lit(0))).alias("var"))


def two_means(table: DataFrame, key: str, a, b) -> DataFrame:
    """variable, n_a, n_b, mean_a, mean_b, smd, t, df, p (Welch), d (pooled, a less b), low, high of d by the normal approximation."""
    m = table.groupBy("variable").agg(*(F.max(F.when(F.col(key) == g, F.col(c))).alias(f"{c}_{k}") for k, g in (("a", a), ("b", b)) for c in ("n", "mean", "var")))
    na, nb, va, vb, none = *(F.coalesce(F.col(c), F.lit(0)) for c in ("n_a", "n_b")), F.col("var_a"), F.col("var_b"), F.lit(0.0)
    gap, ea, eb = F.col("mean_a") - F.col("mean_b"), va / na, vb / nb
    t = gap / F.nullif(F.sqrt(ea + eb), none)
    free = (ea + eb) ** 2 / F.nullif(ea**2 / (na - 1) + eb**2 / (nb - 1), none)
    d = gap / F.nullif(F.sqrt(((na - 1) * va + (nb - 1) * vb) / F.nullif(na + nb - 2, F.lit(0))), none)
    reach = NormalDist().inv_cdf(0.975) * F.sqrt((na + nb) / (na * nb) + d * d / (2 * (na + nb)))
    out = m.select("variable", na.alias("n_a"), nb.alias("n_b"), "mean_a", "mean_b", (gap / F.nullif(F.sqrt((va + vb) / 2), none)).alias("smd"), t.alias("t"), free.alias("df"), d.alias("d"), (d - reach).alias("low"), (d + reach).alias("high"))
    return out.withColumn("p", F.when((F.col("n_a") > 1) & (F.col("n_b") > 1), two_sided_t(F.col("t"), F.col("df"))))


def odds(rows: DataFrame) -> DataFrame:
    """variable, n_a, n_b, rate_a, rate_b, odds_ratio (of a to b), low, high (Woolf), chi2 (Yates), p from rows (variable, first, value)
    with values 0 and 1; ``first`` says which rows are group a."""
    of = lambda first, y: F.count_if((F.col("first") == first) & (F.col("value") == y)).cast("double")
    m = rows.groupBy("variable").agg(of(True, 1).alias("a1"), of(True, 0).alias("a0"), of(False, 1).alias("b1"), of(False, 0).alias("b0"))
    a1, a0, b1, b0, none = *(F.col(c) for c in ("a1", "a0", "b1", "b0")), F.lit(0.0)
    n = a1 + a0 + b1 + b0
    gap = F.abs(a1 * b0 - a0 * b1)
    chi2 = n * (gap - F.least(gap, n / 2)) ** 2 / F.nullif((a1 + a0) * (b1 + b0) * (a1 + b1) * (a0 + b0), none)
    ratio = F.nullif(a1 * b0 / F.nullif(a0 * b1, none), none)
    reach = NormalDist().inv_cdf(0.975) * F.sqrt(1 / F.nullif(a1, none) + 1 / F.nullif(a0, none) + 1 / F.nullif(b1, none) + 1 / F.nullif(b0, none))
    out = m.select("variable", (a1 + a0).cast("long").alias("n_a"), (b1 + b0).cast("long").alias("n_b"), (a1 / F.nullif(a1 + a0, none)).alias("rate_a"), (b1 / F.nullif(b1 + b0, none)).alias("rate_b"), ratio.alias("odds_ratio"), F.exp(F.log(ratio) - reach).alias("low"), F.exp(F.log(ratio) + reach).alias("high"), chi2.alias("chi2"))
    return out.withColumn("p", chi_square_sf("chi2", F.lit(1)))


def _flag(column: str) -> F.Column:
    return F.expr(f"try_cast(`{column}` AS double)")


def outcomes_between(df: DataFrame, flags: list[str], key: str, a, b) -> DataFrame:
    """``odds`` of 0/1 outcomes in groups a and b of ``key``, in one pass."""
    rows = df.filter(F.col(key).isin(a, b)).select((F.col(key) == a).alias("first"), *(_flag(c).alias(c) for c in flags))
    return odds(rows.unpivot(["first"], flags, "variable", "value").filter("value IN (0, 1)"))


def flags_screened(df: DataFrame, event: str, flags: list[str]) -> DataFrame:
    """``odds`` of a 0/1 event where each 0/1 predictor is 1 against where it is 0, in one pass."""
    rows = df.select(_flag(event).alias("_e"), *(_flag(c).alias(c) for c in flags)).unpivot(["_e"], flags, "variable", "x").filter("_e IN (0, 1) AND x IN (0, 1)")
    return odds(rows.select("variable", (F.col("x") == 1).alias("first"), F.col("_e").alias("value")))


class Analysis:
    """The steps over one table. ``tables`` has what each gave, ``skipped`` why others gave nothing."""

    def __init__(self, df: DataFrame, plan: Plan | None = None):
        self.df, self.seen = df, levels(df)
        self.plan = (plan or Plan()).derived(df, self.seen)
        self.tables: dict[str, DataFrame] = {}
        self.skipped: dict[str, str] = {}
        p = self.plan
        self.arms = [r[0] for r in df.select(p.arm).filter(F.col(p.arm).isNotNull()).distinct().orderBy(p.arm).limit(51).collect()] if p.arm else []
        if len(self.arms) > 50:
            raise ValueError(f"{p.arm} has more than 50 values: no arm")
        own = {p.arm, p.time, p.event, p.subject, *p.primary, *p.secondary}
        self.numbers = [c for c in numeric_columns(df) if c not in (p.arm, p.time, p.event, p.subject)]
        self.baseline = [c for c in self.numbers if c not in own] if p.outcome != "survival" else [c for c in self.numbers if not self._named_as_outcome(c)]

    @staticmethod
    def _named_as_outcome(name: str) -> bool:
        return plain(name) in tests.OUTCOME_NAMES + tests.FOLLOW_UP_NAMES

    def step(self, name: str, make: Callable[[], DataFrame | None], ready: bool, reason: str) -> DataFrame | None:
        """Runs one step; what is not ``ready``, or fails for its data, is skipped with its reason."""
        if not ready:
            self.skipped[name] = reason
            return None
        try:
            table = make()
        except ValueError as e:
            self.skipped[name] = str(e)
            return None
        if table is not None:
            self.tables[name] = table
        return table

    def run(self) -> Analysis:
        self.integrity()
        self.outcomes()
        self.corrected()
        return self

    # stage 1

    def integrity(self) -> None:
        p, enough = self.plan, len(self.numbers) >= 1
        self.step("digit_preference", lambda: profile.digit_preference(self.df, self.numbers), enough, "no numbers")
        incomplete = profile.missingness(self.df, self.numbers).filter("missing > 0").orderBy("variable").collect() if enough else []  # a row a column
        self.incomplete = [r.variable for r in incomplete][:15]
        self.fillable = [r.variable for r in incomplete if r.percent < FILLED][:15]
        beside = [c for c in self.numbers if c not in self.incomplete]
        self.tested = tested = [*self.incomplete, *beside][: max(2, min(15, len(self.incomplete) + 3))]
        self.step("mcar", lambda: saved(models.little(self.df, tested)), bool(self.incomplete) and len(tested) > 1, "nothing missing, or one column only")
        keys = [c for c in (p.arm, p.event) if c]
        self.moments = cube(self.df, self.numbers, keys) if enough and keys else None
        self.step("balance", self.balance, len(self.arms) > 1 and bool(self.baseline), "no arms, or nothing to compare")

    def balance(self) -> DataFrame:
        """Of 20 baseline columns at most: every arm against the first; flagged if the standardised difference is above 0.1."""
        p = self.plan
        by_arm = folded(self.moments.filter(F.col("variable").isin(self.baseline[:BALANCED])), [p.arm])
        parts = [two_means(by_arm, p.arm, self.arms[0], b).select(F.lit(str(b)).alias("arm"), "variable", "n_a", "n_b", "mean_a", "mean_b", "smd", (F.abs("smd") > 0.1).alias("flagged")) for b in self.arms[1:]]
        return reduce(DataFrame.unionByName, parts)

    # stage 2

    def completed(self) -> DataFrame:
        """The table to analyse: with missing values of numbers filled in if they are not missing completely at random. The pooled means of
        five fillings are a table of their own. Columns of which half or more is missing stay as they are; their tests use what was seen.

        ``little`` rejects at random where a column nearly repeats another one that is complete, as covariances of pairs make no covariance
        matrix then; so what it rejects is filled in only if ``little_likelihood`` rejects it too."""
        if self.incomplete and not self.fillable:
            self.skipped["imputation"] = f"{FILLED} % or more missing: {', '.join(self.incomplete)}"
            return self.df
        verdict = self.tables["mcar"].first() if "mcar" in self.tables else None  # one row
        if verdict is not None and verdict.p is not None and verdict.p < 0.05:
            verdict = models.little_likelihood(self.df, self.tested).first()
        if verdict is None or verdict.p is None or verdict.p >= 0.05:
            self.skipped["imputation"] = "missing completely at random, or nothing missing"
            return self.df
        df, key, predictors = self.df, self.plan.subject, [c for c in self.numbers if c not in self.incomplete][:10]
        if key is None:
            key = "_row"
            df = df.withColumn(key, F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns)))
        if not predictors:
            self.skipped["imputation"] = "no complete column to predict from"
            return self.df
        self.tables["imputation"] = longitudinal.pooled(longitudinal.imputed(df, key, self.fillable, predictors, 5), self.fillable)
        filled = longitudinal.completed(df, key, self.fillable, predictors)
        return filled.select(*self.df.columns)

    def outcomes(self) -> None:
        p = self.plan
        whole = self.completed()
        if whole is not self.df:
            whole = saved(whole)
            self.moments = cube(whole, self.numbers, [c for c in (p.arm, p.event) if c]) if self.moments is not None else None
        self.whole = whole
        two = len(self.arms) > 1
        found = {"continuous": self.continuous, "binary": self.binary, "survival": self.survived, "longitudinal": self.repeated}[p.outcome]()
        self.found = [f for f in found if f is not None]
        endpoint = next(iter([*p.primary, *p.secondary]), None)
        groups = [c for c in p.subgroups if c in whole.columns]
        self.step("subgroups", lambda: self.subgrouped(endpoint, groups), two and bool(groups) and endpoint is not None, "no arms, endpoint or subgroups")
        covariates = [c for c in self.numbers if c != endpoint and c not in p.secondary and (p.outcome == "survival" or c not in p.primary)][:COVARIATES]
        self.step("ancova", lambda: models.ancova_arms(whole, endpoint, p.arm, covariates, self.arms), two and endpoint is not None and bool(covariates) and p.outcome != "binary", "no arms, endpoint or covariates")

    def subgrouped(self, endpoint: str, groups: list[str]) -> DataFrame:
        """The endpoint between each later arm and the first, at each level of each subgroup."""
        make, parts = (inference.subgroup_odds if self.plan.outcome == "binary" else inference.subgroups), []
        for b in self.arms[1:]:
            parts.append(make(self.whole, endpoint, self.plan.arm, groups, self.arms[0], b).withColumn("arm", F.lit(str(b))))
        return reduce(DataFrame.unionByName, parts)

    def _rows(self, table: DataFrame, **columns) -> DataFrame:
        """A table of findings from columns by name; what is not named is null."""
        kinds = [f.split() for f in FINDING.split(", ")]
        own = {k: (F.lit(v) if v is None or isinstance(v, (str, int, float)) else v) for k, v in columns.items()}
        return table.select(*(own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds))

    def _means(self, columns: list[str], key: str, a, b, endpoint) -> list[DataFrame]:
        """Tests of numbers between two groups: Welch from the moments where both groups have 30 values; else by ``compare_groups``."""
        m = saved(two_means(folded(self.moments.filter(F.col("variable").isin(columns)), [key]), key, a, b))
        sure = m.filter((F.col("n_a") >= MEANS_TEST) & (F.col("n_b") >= MEANS_TEST))
        of = lambda name: endpoint if endpoint is not None else F.col(name)
        out = [self._rows(sure, finding=F.col("variable"), endpoint=of("variable"), test="welch", n=F.col("n_a") + F.col("n_b"), n_a=F.col("n_a"), n_b=F.col("n_b"), effect_label="cohen_d", effect=F.col("d"), low=F.col("low"), high=F.col("high"), statistic=F.col("t"), p=F.col("p"))]
        for r in m.filter((F.least("n_a", "n_b") < MEANS_TEST) & (F.least("n_a", "n_b") > 1)).collect():  # a row a column
            c = tests.compare_groups(self.whole, r.variable, key, a, b, self.plan.alpha)
            out.append(self._rows(c, finding=r.variable, endpoint=r.variable if endpoint is None else endpoint, test=F.col("test"), n=F.col("n_a") + F.col("n_b"), n_a=F.col("n_a"), n_b=F.col("n_b"), effect_label="cohen_d", effect=float(r.d) if r.d is not None else None, low=r.low, high=r.high, statistic=F.col("statistic"), p=F.col("p")))
        return out

    def continuous(self) -> list[DataFrame]:
        """Endpoints between two arms; between more, Kruskal-Wallis, with epsilon squared."""
        p, endpoints = self.plan, [*self.plan.primary[:TESTED], *self.plan.secondary]
        if len(self.arms) < 2 or not endpoints:
            self.skipped["tests"] = "no arms or no endpoints"
            return []
        if len(self.arms) == 2:
            return self._means(endpoints, p.arm, *self.arms, None)
        out = []
        for c in endpoints:
            k = assoc.kruskal(self.whole, c, p.arm)
            out.append(self._rows(k, finding=c, endpoint=c, test="kruskal_wallis", n=F.col("n"), effect_label="epsilon_squared", effect=F.col("h") / F.nullif(F.col("n") - 1, F.lit(0)), statistic=F.col("h"), p=F.col("p")))
        return out

    def binary(self) -> list[DataFrame]:
        """0/1 endpoints between two arms, with odds ratios; between more, chi-square and Cramer's V."""
        p, endpoints = self.plan, [*self.plan.primary[:TESTED], *self.plan.secondary]
        if len(self.arms) < 2 or not endpoints:
            self.skipped["tests"] = "no arms or no endpoints"
            return []
        if len(self.arms) == 2:
            s = outcomes_between(self.whole, endpoints, p.arm, self.arms[1], self.arms[0])
            return [self._rows(s, finding=F.col("variable"), endpoint=F.col("variable"), test="chi_square", n=F.col("n_a") + F.col("n_b"), n_a=F.col("n_a"), n_b=F.col("n_b"), effect_label="odds_ratio", effect=F.col("odds_ratio"), low=F.col("low"), high=F.col("high"), statistic=F.col("chi2"), p=F.col("p"))]
        return [self._rows(assoc.chi_square(self.whole, p.arm, c), finding=c, endpoint=c, test="chi_square", n=F.col("n"), effect_label="cramers_v", effect=F.col("cramers_v"), statistic=F.col("chi2"), p=F.col("p")) for c in endpoints]

    def survived(self) -> list[DataFrame]:
        """Log-rank between all arms, and every predictor of the event: numbers by their means, 0/1 columns by odds ratios."""
        p, out = self.plan, []
        if not (p.time and p.event):
            self.skipped["tests"] = "survival needs a time and an event"
            return []
        self.step("survival", lambda: survival.summary(self.whole, p.time, p.event, p.arm) if p.arm else survival.summary(self.whole.withColumn("_all", F.lit("all")), p.time, p.event, "_all"), True, "")
        if len(self.arms) > 1:
            valid = self.whole.filter((F.col(p.time) > 0) & F.col(p.arm).isNotNull()).agg(F.count(F.lit(1)).alias("_n"))
            l = survival.log_rank(self.whole, p.time, p.event, p.arm).crossJoin(valid)  # one row each
            out.append(self._rows(l, finding="survival_primary", endpoint=p.event, test="log_rank", n=F.col("_n"), effect_label="logrank", statistic=F.col("chi2"), p=F.col("p")))
        taken = {plain(c) for c in (p.time, p.event, p.arm, p.subject) if c}
        fits = [c for c in self.df.columns if plain(c) not in taken and not self._named_as_outcome(c)]
        flags = [c for c in fits if self.seen[c][1] and self.seen[c][0] == 2]
        numbers = [c for c in fits if c in self.numbers and c not in flags]
        if flags:
            s = flags_screened(self.whole, p.event, flags)
            out.append(self._rows(s, finding=F.col("variable"), endpoint=p.event, test="chi_square", n=F.col("n_a") + F.col("n_b"), n_a=F.col("n_a"), n_b=F.col("n_b"), effect_label="odds_ratio", effect=F.col("odds_ratio"), low=F.col("low"), high=F.col("high"), statistic=F.col("chi2"), p=F.col("p")))
        if numbers and self.moments is not None:
            out += self._means(numbers, p.event, 1, 0, p.event)
        return out

    def repeated(self) -> list[DataFrame]:
        """The last time's difference between arms, by a mixed model, and with arms held equal at the first time."""
        p = self.plan
        if not (p.time and p.arm and p.primary and p.subject):
            self.skipped["tests"] = "repeated measures need a subject, a time, an arm and an endpoint"
            return []
        y, out = p.primary[0], []
        last, arm = longitudinal._levels(self.whole, p.time)[-1], self.arms[-1]
        for name, model in (("mixed_model", longitudinal.repeated_measures_model), ("constrained_model", longitudinal.constrained_model)):
            fit = self.step(name, lambda model=model: model(self.whole, p.subject, p.time, p.arm, y), True, "")
            if fit is not None:
                own = fit.filter(F.col("term") == f"{p.time}[{last}]:{p.arm}[{arm}]")
                out.append(self._rows(own, finding=f"{y}_{name}", endpoint=y, test=name, n=F.col("rows"), effect_label="mean_difference", effect=F.col("coef"), statistic=F.col("z"), p=F.col("p")))
        return out

    # stage 3

    def corrected(self) -> None:
        """All findings of stage 2: corrected, gated, with power, category, direction and what they say."""
        p = self.plan
        if not self.found:
            self.skipped["findings"] = "nothing was tested"
            return
        found = saved(reduce(DataFrame.unionByName, self.found))
        primary = F.lit(p.outcome in ("survival", "longitudinal")) | F.col("endpoint").isin(p.primary)
        found = found.withColumn("endpoint_type", F.when(primary, "primary").otherwise("secondary")).withColumn("study", F.lit(1))
        out = tests.corrected(found, "finding", "p", ["study"], p.alpha).drop("study")
        out = out.withColumn("correction", F.when(F.col("endpoint_type") == "primary", "Bonferroni").otherwise("Benjamini-Hochberg"))
        d = F.when(F.col("effect_label") == "cohen_d", F.col("effect"))
        out = inference.sample_sizes(inference.power(out.withColumn("_d", d), "_d", "n_a", "n_b", p.alpha), "_d", p.alpha).drop("_d", "power_class")
        self.tables["findings"] = told(out.withColumn("adequate", F.coalesce(F.col("power") >= 0.8, F.lit(False))))

    def summary(self) -> DataFrame:
        """step, state, detail: one row a step; and whether the integrity checks raised concerns, and whether the gate is open."""
        rows = [(name, "done", None) for name in self.tables] + [(name, "skipped", why) for name, why in self.skipped.items()]
        rows.append(("plan", "derived", "; ".join(f"{k}={v}" for k, v in vars(self.plan).items() if v)))
        return self.df.sparkSession.createDataFrame(rows, "step string, state string, detail string")


def told(found: DataFrame) -> DataFrame:
    """Adds category, direction, direction_label and sentence to findings with finding, endpoint, effect_label, effect, significant.

    The log-rank row and follow-up times are notes, columns that are the endpoint or are named like an outcome are excluded artifacts; others
    are associations, or negative ones if not significant. An odds ratio's direction is its side of 1, else the effect's sign. The
    sentence of an artifact or a note is null, as such rows state no association.
    """
    name = F.regexp_replace(F.lower("finding"), "[^a-z0-9]+", "")
    same = F.coalesce(F.lower("finding") == F.lower("endpoint"), F.lit(False)) & ~F.col("effect_label").isin("cohen_d", "odds_ratio", "epsilon_squared", "cramers_v")
    category = F.when((F.col("finding") == "survival_primary") | name.isin(tests.FOLLOW_UP_NAMES), "statistical_note").when(same | name.isin(tests.OUTCOME_NAMES), "artifact_excluded").when(F.col("significant"), "clinical_association").otherwise("negative_association")
    null_at = F.when(F.col("effect_label") == "odds_ratio", 1.0).when(F.col("effect_label").isin("cohen_d", "mean_difference"), 0.0)
    way = F.when(null_at.isNull() | F.col("effect").isNull(), "unknown").when(F.col("effect") > null_at, "positive").when(F.col("effect") < null_at, "negative").otherwise("none")
    subject = F.replace(F.col("finding"), F.lit("_"), F.lit(" "))
    outcome = F.when(F.lower("endpoint").rlike("death|mortality"), "mortality").when(F.lower("endpoint").contains("survival"), "survival").otherwise(F.replace(F.coalesce("endpoint", F.lit("the outcome")), F.lit("_"), F.lit(" ")))
    higher = lambda word: F.concat(F.lit("higher "), subject, F.lit(f" associated with {word} "), outcome)
    label = F.when(~F.col("significant"), "no statistically significant association").when(F.col("_way") == "positive", higher("higher")).when(F.col("_way") == "negative", higher("lower")).when(F.col("_way") == "none", "no directional difference").otherwise("direction not established")
    out = found.withColumn("category", category).withColumn("_way", way).withColumn("direction_label", label)
    begun = lambda text: F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    said = F.when(F.col("significant"), F.concat(begun(F.when(F.col("_way").isin("positive", "negative"), F.concat(F.lit("higher "), subject, F.lit(" was associated with "), F.when(F.col("_way") == "positive", "higher ").otherwise("lower "), outcome)).otherwise(F.concat(subject, F.lit(" was associated with "), outcome))), F.lit(".")))
    said = said.otherwise(F.concat(begun(subject), F.lit(" showed no significant association with "), outcome, F.lit(".")))
    return out.withColumn("sentence", F.when(F.col("category").isin("clinical_association", "negative_association"), said)).withColumnRenamed("_way", "direction")


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, rho of all pairs of columns. Columns without missing values are ranked once and correlated in one aggregate; a pair with
    a column that has some is ranked over its complete rows."""
    full = df.agg(*(F.count_if(missing(c, df)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    whole = [c for i, c in enumerate(columns) if not full[f"m{i}"]]
    parts = [assoc.spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho") for a, b in combinations(columns, 2) if not (a in whole and b in whole)]
    if len(whole) > 1:
        rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(whole)))
        counts = longform.value_counts(long(rows, [f"v{i}" for i in range(len(whole))]), ["variable"])
        ranked = saved(longform.ranged(counts, ["variable"]).select("variable", "value", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank")))
        for i in range(len(whole)):
            own = ranked.filter(F.col("variable") == f"v{i}").select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
            rows = rows.join(own, f"v{i}")
        n = df.agg(F.count(F.lit(1)).alias("n"))
        rho = assoc.correlations(rows, [f"r{i}" for i in range(len(whole))])
        names = F.create_map(*[x for i, c in enumerate(whole) for x in (F.lit(f"r{i}"), F.lit(c))])
        parts.append(rho.select(F.element_at(names, F.col("a")).alias("a"), F.element_at(names, F.col("b")).alias("b"), F.col("r").alias("rho")).crossJoin(F.broadcast(n)).select("a", "b", "n", "rho"))  # n: one row
    return reduce(DataFrame.unionByName, parts)


def report(df: DataFrame, plan: Plan | None = None, path: str | None = None, strong: float = 0.6) -> dict[str, DataFrame]:
    """The tables of a static report, by name: overview, duplicates, missingness, coercions, statistics, categories, outliers, normality,
    correlations (Spearman, with strong from 0.6 on), the steps of the analysis and all their tables. With ``path`` each is written as Parquet under it."""
    work = Analysis(df, plan).run()
    numbers, words = numeric_columns(df), [c for c, k in df.dtypes if k == "string"]
    tables = {"overview": guardrails.overview(df), "duplicates": profile.duplicates(df, df.columns), "coercions": guardrails.coercions(df, [])}
    if numbers:
        tables |= {"missingness": profile.missingness(df, numbers), "statistics": profile.column_statistics(df, numbers), "outliers": profile.outliers(df, numbers), "normality": inference.normality(df, numbers)}
    if len(numbers) > 1:
        tables["correlations"] = spearman_matrix(df, numbers).withColumn("strong", F.coalesce(F.abs("rho") >= strong, F.lit(False)))
    if words:
        tables["categories"] = profile.categories(df, words)
    if words and len(work.arms) == 2:
        tables["balance_categories"] = profile.balance_categories(df, work.plan.arm, [c for c in words if c != work.plan.arm])
    tables |= {"steps": work.summary(), **work.tables}
    if path is not None:
        for name, table in tables.items():
            table.write.mode("errorifexists").parquet(f"{path}/{name}")
    return tables
