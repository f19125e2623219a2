"""Written claims: candidates from reports, what they state, whether recomputed results bear them out, and evidence scores."""

from __future__ import annotations

import heapq
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators.evidence import terms
from cohortlake.operators.longform import need, saved
from cohortlake.operators.order import Ranges

# Lines that head a section of a report.
SECTIONS = ["summary", "overview", "results", "findings", "conclusion", "recommendations", "discussion", "survival", "baseline", "analysis", "clinical analysis", "clinical analysis report", "analytical findings", "statistical notes", "data quality notes"]
# Phrases that deny, assert, raise, lower, and tell of adjustment.
DENIES = ["not significant", "no significant", "non-significant", "no association", "no relationship", "did not show", "was not associated"]
ASSERTS = ["significant", "associated", "association", "predicts", "predictor", "correlated", "differed"]
UP, DOWN = ["higher", "increased", "elevated", "positive"], ["lower", "decreased", "reduced", "negative"]
ADJUSTED = ["adjusted", "after adjustment", "after adjusting", "controlling for", "controlled for", "multivariable", "multivariate", "independent predictor", "independently associated"]
# Study types, their patterns and scores, first match wins.
STUDIES = [
    ("meta-analysis", 40, r"meta.?analysis|systematic.?review"),
    ("RCT", 32, r"randomized.?controlled|randomised.?controlled|rct\b"),
    ("RCT", 28, r"randomized|randomised|random.?assignment"),
    ("cohort", 20, r"cohort|prospective|longitudinal"),
    ("observational", 12, r"case.?control|observational|cross.?sectional"),
    ("case study", 4, r"case.?report|case.?series|case.?study"),
]
# What comes before a study's size.
SIZE_WORDS = ["n =", "sample", "sample of", "sample size", "sample size of", "enrolled", "included", "participant =", "participant :", "participants =", "participants :"]
# The kinds of test with the phrases that name them, first match wins; all of a group must be there.
FAMILIES = [
    ("baseline_balance", [["baseline"], ["balance", "smd"]]), ("correlation", [["correlat"]]), ("cox_survival_predictor", [["cox", "hazard"]]), ("kaplan_meier_logrank", [["log-rank", "log rank", "kaplan"]]),
    ("logistic_regression", [["odds ratio", "logistic"]]), ("binary_categorical_association", [["associat", "relationship"]]),
    ("continuous_group_difference", [["difference", "differed", "higher", "lower", "increased", "decreased", "between"]]),
]
#: A signed number, which may begin with its point; and an interval: its name, what introduces it, and two numbers with a comma, "to" or a dash between them.
NUMBER = r"([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)"
INTERVAL = rf"(?i)\b(?:CI|confidence interval)\b[^0-9.+-]{{0,8}}{NUMBER}\s*(?:[,;–-]|to)\s*{NUMBER}"


def introduced(phrases: list[str], what: str) -> str:
    """A pattern for ``what`` after any of the phrases: blanks, one at least, stand between words, and as many as one likes around signs."""
    def spaced(phrase: str) -> str:
        out = ""
        for part in phrase.split():
            out += ("" if not out else r"\s+" if part.isalpha() else r"\s*") + re.escape(part)
        return out + (r"\s+" if phrase[-1].isalpha() else r"\s*")

    return rf"\b(?:{'|'.join(map(spaced, sorted(phrases, key=len, reverse=True)))}){what}"


SAMPLE_SIZE = introduced(SIZE_WORDS, "([0-9][0-9,]*)")


def says(text, phrases: list[str]) -> F.Column:
    lower = F.lower(text)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(lower, p))


def split_claims(reports: DataFrame, key: str, text: str, long_line: int = 180, words: int = 4) -> DataFrame:
    """key, line, part, claim: each line without its bullet, long ones cut at sentence ends, of ``words`` words at least."""
    need(reports, key, text)
    lines = reports.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "l"))
    # a first word that is a mark or a number with a point or bracket is no part of the line
    word = F.split(F.ltrim("l"), r"\s+", 2)
    marked = word[0].isin("•", "*", "-") | word[0].rlike(r"^[0-9]+[.)]$")
    bare = F.trim(F.when(marked & (F.size(word) > 1), F.try_element_at(word, F.lit(2))).otherwise(F.col("l")))
    parts = lines.select(key, "line", bare.alias("l")).select(key, "line", F.posexplode(F.when(F.length("l") >= long_line, F.split("l", r"(?<=[.!?])\s+")).otherwise(F.array("l"))).alias("part", "c"))
    claim = F.trim("c")
    return parts.select(key, "line", "part", claim.alias("claim")).filter(F.size(F.split("claim", r"\s+")) >= words)


def sectioned_claims(reports: DataFrame, key: str, text: str, headers: list[str] = SECTIONS, long_line: int = 160) -> DataFrame:
    """key, line, part, claim, section: the parts of every line, and the last line above that is one of ``headers`` (in any case, with or without a
    colon), null above the first. Headers themselves are left out.

    Rows of one ``key`` are one report, read by line. The section is a running maximum over ranges of lines, so no task holds a report.
    """
    parts = split_claims(reports, key, text, long_line, words=1).filter("claim <> ''")
    name = F.trim(F.lower(F.rtrim(F.col("claim"), F.lit(":"))))
    header = F.when(name.isin(headers), F.struct("line", "part", name.alias("name")))
    ranges = Ranges(parts.withColumn("_header", header), [key], ["line", "part"])
    return ranges.running(ranges.rows, _last=("max", "_header")).filter("_header IS NULL").select(key, "line", "part", "claim", F.col("_last.name").alias("section"))


def interval(claims: DataFrame, text: str) -> DataFrame:
    """Adds ci_low and ci_high as the text states them, in order."""
    a, b = (F.expr(f"try_cast({c} AS double)") for c in ("_a", "_b"))
    out = claims.withColumn("_a", F.regexp_extract(text, INTERVAL, 1)).withColumn("_b", F.regexp_extract(text, INTERVAL, 2))
    return out.withColumn("ci_low", F.when(b.isNotNull(), F.least(a, b))).withColumn("ci_high", F.when(a.isNotNull(), F.greatest(a, b))).drop("_a", "_b")


def direction(text) -> F.Column:
    """positive, negative or null; a denied word gives null."""
    denied = says(text, [f"not {w}" for w in UP + DOWN])
    return F.when(denied, None).when(says(text, UP), "positive").when(says(text, DOWN), "negative")


def family(text) -> F.Column:
    """The kind of test a claim speaks of, in fixed order, null if none."""
    out = F.lit(None).cast("string")
    for name, groups in reversed(FAMILIES):
        holds = F.lit(True)
        for phrases in groups:
            holds = holds & says(text, phrases)
        out = F.when(holds, name).otherwise(out)
    return out


def significant(text, operator, p) -> F.Column:
    """What the claim says of significance: denial first, then its p-value, then assertion; null if it says nothing."""
    by_p = F.when((operator.isin("<", "<=") & (p <= 0.05)) | ((operator == "=") & (p < 0.05)), True).when(operator.isin(">", ">=", "=") & (p >= 0.05), False)
    return F.when(says(text, DENIES), False).otherwise(F.coalesce(by_p, F.when(says(text, ASSERTS), True)))


def verdict(claims: DataFrame, text: str, found: str, way: str) -> DataFrame:
    """Adds verdict: does the recomputed p ``found`` and direction ``way`` bear out significant, p_operator, p_value and
    the direction that the text gives? A claim of an adjusted model is not verifiable."""
    p, own, op, said = F.col(found), F.col("significant"), F.col("p_operator"), F.col("p_value")
    real = p < 0.05
    match = F.when(said.isNull(), True).when(op == "<", p < said).when(op == "<=", p <= said).when(op == ">", p > said).when(op == ">=", p >= said).otherwise(F.abs(said - p) <= F.greatest(F.lit(0.001), said * 0.25))
    side = direction(F.col(text))
    out = (
        F.when(says(F.col(text), ADJUSTED), "not_verifiable").when(p.isNull(), "unsupported").when(own.isNull(), "partial").when(own != real, "contradicted")
        .when(real & side.isNotNull() & F.col(way).isNotNull() & (side != F.col(way)), "contradicted").when(real & side.isNotNull() & F.col(way).isNull(), "partial").when(~match, "partial").otherwise("verified")
    )
    return claims.withColumn("verdict", out)


def verdict_counts(claims: DataFrame) -> DataFrame:
    """claims, one count a verdict, and the share verified of those that could be checked."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    names = ["verified", "contradicted", "partial", "unsupported", "not_verifiable"]
    checked = of("verified") + of("contradicted") + of("partial")
    return claims.agg(F.count(F.lit(1)).alias("claims"), *(of(v).alias(v) for v in names), (of("verified") / F.nullif(checked, F.lit(0))).alias("verified_rate"))


class _Topic:
    """The right rows of a topic by token set; rows of a set differ in their keys only."""

    def __init__(self, sets: dict):
        self.rows, self.sizes, self.alive = list(sets.values()), np.array([max(1, len(s)) for s in sets]), np.ones(len(sets), bool)
        where: dict = {}
        for c, words in enumerate(sets):
            for w in words:
                where.setdefault(w, []).append(c)
        self.where = {w: np.array(c) for w, c in where.items()}

    def best(self, words: frozenset, used: set, least: float):
        """(score, key) of the best row left for a set of tokens, ties to the smaller key; or None."""
        common = np.zeros(len(self.rows))
        for w in words:
            if w in self.where:
                common[self.where[w]] += 1
        score = np.floor((0.5 + 0.5 * (common / np.maximum(self.sizes, len(words)))) * 1e6 + 0.5) / 1e6
        while True:
            score[~self.alive] = -1
            top = float(score.max())
            if top < max(least, 0):
                return None
            heads = []
            for c in np.flatnonzero(score == top):
                while self.rows[c] and self.rows[c][0] in used:
                    self.rows[c].popleft()
                if self.rows[c]:
                    heads.append(self.rows[c][0])
                else:
                    self.alive[c] = False
            if heads:
                return top, min(heads)


def _sets(table: pa.Table, key: str, on: str, words: str) -> dict:
    """topic: {token set: its keys in order}."""
    out: dict = {}
    for r in sorted(table.to_pylist(), key=lambda r: r[key]):
        out.setdefault(r[on], {}).setdefault(frozenset(r[words]), deque()).append(r[key])
    return out


def _assign(left: dict, right: dict, least: float) -> list:
    """(l, r, score), best first. The heap holds the best pair of each token set on the left as last seen; rows are only
    used up, so one whose rows are both free is the best of all."""
    topics = {t: _Topic(sets) for t, sets in right.items()}
    sets = [(t, words, rows) for t, own in left.items() if t in topics for words, rows in own.items()]
    used_l, used_r, out, heap = set(), set(), [], []

    def push(c: int) -> None:
        t, words, rows = sets[c]
        while rows and rows[0] in used_l:
            rows.popleft()
        found = topics[t].best(words, used_r, least) if rows else None
        if found:
            heapq.heappush(heap, (-found[0], rows[0], found[1], c))

    for c in range(len(sets)):
        push(c)
    while heap:
        score, l, r, c = heapq.heappop(heap)
        if l not in used_l and r not in used_r:
            out.append((l, r, -score))
            used_l.add(l), used_r.add(r)
        push(c)
    return out


def _pooled(a: DataFrame, b: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Adds pool: the topic, or the least of those that keys of several topics connect."""
    ties = a.select(F.concat(F.lit("l"), F.col("l").cast("string")).alias("k"), on).union(b.select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("k"), on)).distinct()
    several = ties.groupBy("k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("k")
    ties = saved(ties.join(several, "k"))
    if ties.isEmpty():
        return a.withColumn("pool", F.col(on)), b.withColumn("pool", F.col(on))
    pools = ties.select(on, F.col(on).alias("pool")).distinct()
    while True:
        low = ties.join(pools, on).groupBy("k").agg(F.min("pool").alias("pool"))
        new = saved(ties.join(low, "k").groupBy(on).agg(F.min("pool").alias("pool")))
        if new.join(pools, [on, "pool"], "left_anti").isEmpty():
            return tuple(d.join(new, on, "left").withColumn("pool", F.coalesce("pool", on)) for d in (a, b))
        pools = new


def pair(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str, on: str, least: float = 0.28) -> DataFrame:
    """lkey, rkey, score: one-to-one pairs of rows that agree in ``on``, highest score first (0.5 and half the share of
    common tokens), ties by keys. Rows without key, topic or text take no part.

    A topic is assigned in one task, which holds its rows but not its pairs; topics that share a key go together. Rows
    of equal tokens are compared once.
    """
    a = left.select(F.col(lkey).alias("l"), on, F.array_distinct(terms(F.col(ltext))).alias("lt")).dropna()
    b = right.select(F.col(rkey).alias("r"), on, F.array_distinct(terms(F.col(rtext))).alias("rt")).dropna()
    a, b = _pooled(a, b, on)

    def assign(x: pa.Table, y: pa.Table) -> pa.Table:
        out = _assign(_sets(x, "l", on, "lt"), _sets(y, "r", on, "rt"), least) if x.num_rows and y.num_rows else []
        ls, rs, scores = zip(*out) if out else ((), (), ())
        return pa.table({lkey: pa.array(ls, x.schema.field("l").type), rkey: pa.array(rs, y.schema.field("r").type), "score": pa.array(scores, pa.float64())})

    kind = T.StructType([T.StructField(lkey, a.schema["l"].dataType), T.StructField(rkey, b.schema["r"].dataType), T.StructField("score", T.DoubleType())])
    return a.groupBy("pool").cogroup(b.groupBy("pool")).applyInArrow(assign, kind)


def evidence_strength(articles: DataFrame, text: str, year: str, now: int) -> DataFrame:
    """Adds study_type, sample_size, strength (0 to 100: recency, study type, size) and strength_label."""
    t, age = F.lower(text), F.lit(now) - F.col(year)
    recent = F.when(age <= 2, 40).when(age <= 5, 30).when(age <= 10, 20).when(age <= 20, 10).otherwise(0)
    kind, points = F.lit(None), F.lit(None)
    for name, score, rule in reversed(STUDIES):
        kind, points = F.when(t.rlike(rule), name).otherwise(kind), F.when(t.rlike(rule), score).otherwise(points)
    size = F.expr("try_cast(replace(_n, ',', '') AS long)")
    out = articles.withColumn("_n", F.regexp_extract(t, SAMPLE_SIZE, 1)).withColumn("sample_size", size).drop("_n")
    n = F.col("sample_size")
    many = F.when(n.isNull(), 5).when(n >= 10_000, 20).when(n >= 1_000, 15).when(n >= 100, 10).when(n >= 20, 5).otherwise(0)
    out = out.withColumn("study_type", F.coalesce(kind, F.lit("unknown"))).withColumn("strength", F.coalesce(recent, F.lit(0)) + F.coalesce(points, F.lit(8)) + many)
    return out.withColumn("strength_label", F.when(F.col("strength") >= 70, "Strong").when(F.col("strength") >= 45, "Moderate").when(F.col("strength") >= 20, "Weak").otherwise("Insufficient"))
