"""Two sets of findings side by side: which claims pair, whether they agree, how closely their statistics do, and the score of it all.

Findings are rows with key, report, variable, endpoint, claim_type, text, significant, direction (positive, negative, none or unknown) and, for
the statistics, p, effect, effect_label, ci_low, ci_high, test_family, rank; any may be null but key and report.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.evidence import terms
from cohortlake.operators.longform import need

FIELDS = ["key", "variable", "endpoint", "claim_type", "text", "significant", "direction", "p", "effect", "effect_label", "ci_low", "ci_high", "test_family", "rank"]
# Effects whose null value is 1, and the others that can be compared.
RATIOS, DIFFERENCES = ["odds_ratio", "hazard_ratio", "risk_ratio"], ["correlation", "cohen_d", "smd", "cramers_v", "mean_difference", "auc"]
# Families of tests that say nearly the same.
ALIKE = [("logistic_or_binary_association", "categorical_association"), ("survival_regression", "survival_group_comparison"), ("group_difference", "categorical_association")]


def _outcome(endpoint) -> F.Column:
    """Mortality and survival are one endpoint."""
    return F.when(endpoint.isin("mortality", "survival"), "mortality").otherwise(endpoint)


def overlap(a, b) -> F.Column:
    """Share of common tokens, each as often as both texts have it, of the longer text's."""
    count = lambda words, t: F.size(F.filter(words, lambda x: x == t))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))
    return F.coalesce(common / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def candidates(left: DataFrame, right: DataFrame, least: float = 0.28) -> DataFrame:
    """report and the fields of both sides (l_..., r_...) and score of the pairs that may speak of one claim.

    Half the score is the same variable, a quarter the same endpoint, a tenth the same type of claim (half of that if either has none), the rest
    common words. Rows with different variables never pair, and below ``least`` nothing does: so candidates meet on the variable, or, where
    one has none, on the endpoint, never as all pairs of a report.
    """
    need(left, "report", *FIELDS), need(right, "report", *FIELDS)
    l = left.select("report", *(F.col(c).alias(f"l_{c}") for c in FIELDS)).withColumn("_lt", terms(F.coalesce("l_text", F.lit("")))).withColumn("_lo", _outcome(F.col("l_endpoint")))
    r = right.select("report", *(F.col(c).alias(f"r_{c}") for c in FIELDS)).withColumn("_rt", terms(F.coalesce("r_text", F.lit("")))).withColumn("_ro", _outcome(F.col("r_endpoint")))
    same = l.join(r.withColumnRenamed("report", "_report"), (F.col("report") == F.col("_report")) & (F.col("l_variable") == F.col("r_variable")))
    open_ = l.join(r.withColumnRenamed("report", "_report"), (F.col("report") == F.col("_report")) & (F.col("_lo") == F.col("_ro"))).filter("l_variable IS NULL OR r_variable IS NULL")
    pairs = same.union(open_)
    variable, endpoint = F.coalesce(F.col("l_variable") == F.col("r_variable"), F.lit(False)), F.coalesce(F.col("_lo") == F.col("_ro"), F.lit(False))
    claim = F.when(F.col("l_claim_type").isNull() | F.col("r_claim_type").isNull(), 0.5).when(F.col("l_claim_type") == F.col("r_claim_type"), 1.0).otherwise(0.0)
    score = 0.5 * variable.cast("double") + 0.25 * endpoint.cast("double") + 0.1 * claim + 0.15 * overlap(F.col("_lt"), F.col("_rt"))
    return pairs.withColumn("score", F.round(F.least(score, F.lit(1.0)), 6)).filter(F.col("score") >= least).drop("_lt", "_rt", "_lo", "_ro", "_report")


def assigned(pairs: DataFrame) -> DataFrame:
    """The pairs that stand when the best is taken first, ties by keys, and each side is used once. A report is one task, which holds the keys
    and scores of its candidates."""

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "l_key", "r_key"], ascending=[False, True, True], kind="stable")
        left, right, rows = set(), set(), []
        for i, (l, r) in enumerate(zip(part["l_key"], part["r_key"])):
            if l not in left and r not in right:
                left.add(l), right.add(r), rows.append(i)
        return part.iloc[rows]

    slim = pairs.select("report", "l_key", "r_key", "score")
    chosen = slim.groupBy("report").applyInPandas(greedy, slim.schema).drop("score")
    return pairs.join(chosen, ["report", "l_key", "r_key"])


def unmatched(findings: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """The findings of side l or r that no match has."""
    return findings.join(matches.select("report", F.col(f"{side}_key").alias("key")), ["report", "key"], "left_anti")


def relation(pairs: DataFrame) -> DataFrame:
    """Adds relation to pairs of one variable: contradict if significance differs, or directions do and both are significant; agree if
    significance is known and equal, directions are equal or one unknown, and endpoints are one or one is missing; else partial_agree. Null for others."""
    ls, rs, ld, rd = F.col("l_significant"), F.col("r_significant"), F.coalesce("l_direction", F.lit("unknown")), F.coalesce("r_direction", F.lit("unknown"))
    same_end = F.coalesce(_outcome(F.col("l_endpoint")) == _outcome(F.col("r_endpoint")), F.lit(False)) | F.col("l_endpoint").isNull() | F.col("r_endpoint").isNull()
    signed = ["positive", "negative"]
    out = (
        F.when(F.coalesce(ls != rs, F.lit(False)), "contradict").when(F.coalesce(ls & rs, F.lit(False)) & ld.isin(signed) & rd.isin(signed) & (ld != rd), "contradict")
        .when(F.coalesce(ls == rs, F.lit(False)) & ((ld == "unknown") | (rd == "unknown") | (ld == rd)) & same_end, "agree").otherwise("partial_agree")
    )
    return pairs.withColumn("relation", F.when(F.coalesce(F.col("l_variable") == F.col("r_variable"), F.lit(False)), out))


def agreement(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds, for each part of the statistical evidence, its label, then agreement (the weighted mean of the parts that can be compared), coverage
    (their share of all weight) and agreement_label. Weights: significance 0.25, direction 0.2, effect 0.25, p 0.1, interval 0.15, test 0.05, and
    rank 0.05 where both have one. Ratios are compared by their logarithms, p by powers of ten. A side without any number is not assessed."""
    col = lambda side, c: F.col(f"{side}_{c}")
    numbers = ["p", "effect", "ci_low", "ci_high", "rank"]
    assessed = F.coalesce(*(col("l", c).cast("double") for c in numbers)).isNotNull() & F.coalesce(*(col("r", c).cast("double") for c in numbers)).isNotNull()
    sig = {s: F.coalesce(col(s, "significant"), col(s, "p") < alpha) for s in "lr"}
    way = {s: F.coalesce(col(s, "direction"), F.lit("unknown")) for s in "lr"}
    both = sig["l"].isNotNull() & sig["r"].isNotNull()
    labels: dict[str, F.Column] = {}
    labels["significance"] = F.when(both, F.when(sig["l"] == sig["r"], "agree").otherwise("conflict")).otherwise("not_assessed")
    known = (way["l"] != "unknown") & (way["r"] != "unknown")
    undirected = (way["l"] == "none") | (way["r"] == "none")
    labels["direction"] = F.when(~known, "not_assessed").when(way["l"] == way["r"], "agree").when(undirected, "half").when(F.coalesce(sig["l"] & sig["r"], F.lit(False)), "conflict").otherwise("partial")
    x, y, label = col("l", "effect"), col("r", "effect"), col("l", "effect_label")
    comparable = x.isNotNull() & y.isNotNull() & F.coalesce(label == col("r", "effect_label"), F.lit(False))
    ratio, gap = label.isin(RATIOS), F.abs(x - y)
    logs = F.abs(F.log(x) - F.log(y))
    opposite = F.when(ratio, (x - 1) * (y - 1) < 0).when(label.isin("correlation", "cohen_d", "smd", "mean_difference"), x * y < 0).otherwise(F.lit(False))
    near = F.when(ratio & ((x <= 0) | (y <= 0)), "not_comparable").when(F.when(ratio, logs <= 0.25).otherwise(gap <= 0.10), "close").when(F.when(ratio, logs <= 0.70).otherwise(gap <= 0.30), "moderate").otherwise("far")
    labels["effect"] = F.when(x.isNull() | y.isNull(), "not_assessed").when(~comparable | ~label.isin(RATIOS + DIFFERENCES), "not_comparable").when(opposite, "opposite").otherwise(near)
    p, q = col("l", "p"), col("r", "p")
    powers = F.abs(F.log10(F.greatest(p, F.lit(1e-300))) - F.log10(F.greatest(q, F.lit(1e-300))))
    labels["p"] = F.when(p.isNull() | q.isNull(), "not_assessed").when((p < alpha) != (q < alpha), "conflict").when(powers <= 0.5, "close").when(powers <= 1.0, "moderate").otherwise("different_strength")
    null = F.when(F.coalesce(col("l", "effect_label"), col("r", "effect_label")).isin(RATIOS), 1.0).otherwise(0.0)
    excludes = {s: (col(s, "ci_high") < null) | (col(s, "ci_low") > null) for s in "lr"}
    meets = F.greatest(col("l", "ci_low"), col("r", "ci_low")) <= F.least(col("l", "ci_high"), col("r", "ci_high"))
    whole = sum((col(s, c).isNull().cast("int") for s in "lr" for c in ("ci_low", "ci_high")), F.lit(0)) == 0
    alike = excludes["l"] == excludes["r"]
    labels["interval"] = F.when(~whole, "not_assessed").when(meets & alike, "agree").when(meets, "partial").when(~alike, "apart").otherwise("weak")
    f, g = col("l", "test_family"), col("r", "test_family")
    close = F.lit(False)
    for a, b in ALIKE:
        close = close | ((f == a) & (g == b)) | ((f == b) & (g == a))
    labels["test"] = F.when(f.isNull() & g.isNull(), "not_assessed").when(f.isNull() | g.isNull(), "partial").when(f == g, "agree").when(close, "compatible").otherwise("not_comparable")
    steps = F.abs(col("l", "rank") - col("r", "rank"))
    labels["rank"] = F.when(steps.isNull(), "not_assessed").when(steps == 0, "agree").when(steps == 1, "partial").otherwise("weak")
    worth = {
        "significance": (0.25, {"agree": 1.0, "conflict": 0.0}), "direction": (0.20, {"agree": 1.0, "half": 0.5, "conflict": 0.0, "partial": 0.4}),
        "effect": (0.25, {"opposite": 0.0, "close": 1.0, "moderate": 0.65, "far": 0.2}), "p": (0.10, {"conflict": 0.0, "close": 1.0, "moderate": 0.7, "different_strength": 0.4}),
        "interval": (0.15, {"agree": 1.0, "partial": 0.65, "apart": 0.35, "weak": 0.45}), "test": (0.05, {"agree": 1.0, "compatible": 0.7, "not_comparable": 0.3, "partial": 0.5}), "rank": (0.05, {"agree": 1.0, "partial": 0.6, "weak": 0.25}),
    }
    out = pairs
    for name, c in labels.items():
        out = out.withColumn(f"{name}_agreement", F.when(assessed, c).otherwise("not_assessed"))
    total = weight = F.lit(0.0)
    for name, (w, scores) in worth.items():
        score = F.lit(None).cast("double")
        for k, v in scores.items():
            score = F.when(F.col(f"{name}_agreement") == k, v).otherwise(score)
        total, weight = total + F.coalesce(w * score, F.lit(0.0)), weight + F.when(score.isNotNull(), w).otherwise(0.0)
    possible = F.when(F.col("rank_agreement") != "not_assessed", 1.05).otherwise(1.0)
    out = out.withColumn("agreement", F.round(total / F.nullif(weight, F.lit(0.0)), 6)).withColumn("coverage", F.round(weight / possible, 6))
    against = (F.col("significance_agreement") == "conflict") | (F.col("direction_agreement") == "conflict") | (F.col("effect_agreement") == "opposite") | (F.col("p_agreement") == "conflict")
    label = F.when(F.col("agreement").isNull(), "not_assessed").when(against, "contradiction").when(F.col("agreement") >= 0.85, "strong").when(F.col("agreement") >= 0.60, "moderate").otherwise("weak")
    return out.withColumn("agreement_label", label)


def settled(pairs: DataFrame) -> DataFrame:
    """``relation`` after ``agreement``: contradicting statistics make a contradiction, far ones a partial agreement of an agreement."""
    far = F.col("agreement_label").isin("weak", "moderate") & (F.col("effect_agreement").isin("far", "opposite") | (F.col("p_agreement") == "different_strength"))
    return pairs.withColumn("relation", F.when(F.col("agreement_label") == "contradiction", "contradict").when((F.col("relation") == "agree") & far, "partial_agree").otherwise(F.col("relation")))


def metrics(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """For each report: lefts, rights, pairs, left_only, right_only, precision, recall, f1, mcc (of significance), novel, agree, partial, contradict
    and their rates, mean_agreement, mean_coverage."""
    a, b = left.groupBy("report").agg(F.count(F.lit(1)).alias("lefts")), right.groupBy("report").agg(F.count(F.lit(1)).alias("rights"))
    both = lambda x, y: F.count_if((F.col("l_significant") == x) & (F.col("r_significant") == y)).cast("double")
    is_ = lambda k: F.count_if(F.col("relation") == k)
    m = matches.groupBy("report").agg(F.count(F.lit(1)).alias("pairs"), is_("agree").alias("agree"), is_("partial_agree").alias("partial"), is_("contradict").alias("contradict"), F.avg("agreement").alias("mean_agreement"), F.avg("coverage").alias("mean_coverage"), both(True, True).alias("tp"), both(False, False).alias("tn"), both(True, False).alias("fp"), both(False, True).alias("fn"))
    t = a.join(b, "report", "full").join(m, "report", "left").fillna(0, ["lefts", "rights", "pairs", "agree", "partial", "contradict", "tp", "tn", "fp", "fn"])
    share = lambda x, y: F.round(F.coalesce(F.col(x) / F.nullif(y, F.lit(0)), F.lit(0.0)), 4)
    t = t.withColumn("precision", share("pairs", "lefts")).withColumn("recall", share("pairs", "rights"))
    mcc = (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / F.nullif(F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))), F.lit(0.0))
    f1 = F.round(F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)), 4)
    t = t.withColumn("left_only", F.col("lefts") - F.col("pairs")).withColumn("right_only", F.col("rights") - F.col("pairs"))
    return t.select(
        "report", "lefts", "rights", "pairs", "left_only", "right_only", "precision", "recall", f1.alias("f1"), F.round(mcc, 4).alias("mcc"), share("left_only", "lefts").alias("novel"), "agree", "partial", "contradict",
        share("agree", "pairs").alias("agree_rate"), share("contradict", "pairs").alias("contradict_rate"), F.round("mean_agreement", 4).alias("mean_agreement"), F.round(F.coalesce("mean_coverage", F.lit(0.0)), 4).alias("mean_coverage"),
    )


def upgrades(matches: DataFrame, left: str, right: str) -> DataFrame:
    """report, pairs, upgrades, upgrade_rate: of each report's pairs those whose left finding has the stronger evidence (``left`` above ``right``; a
    null score is no upgrade)."""
    out = matches.groupBy("report").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col(left) > F.col(right)).alias("upgrades"))
    return out.withColumn("upgrade_rate", F.round(F.col("upgrades") / F.col("pairs"), 4))


def effect_check(claims: DataFrame, kind: str, claimed: str, found: str, low: str, high: str) -> DataFrame:
    """Adds effect_verdict: contradicted if the claimed and the recomputed effect lie on opposite sides of the null; partial if ratios differ by 1.5 times
    or others by 0.2 and half the claim, or the claimed interval holds the null and the recomputed effect is away from it; else verified; null without both."""
    null = F.when(F.col(kind).isin(RATIOS), 1.0).otherwise(0.0)
    x, y = F.col(claimed), F.col(found)
    ratio = F.greatest(x / F.nullif(y, F.lit(0.0)), y / F.nullif(x, F.lit(0.0)))
    far = F.when(F.col(kind).isin(RATIOS), ratio >= 1.5).otherwise(F.abs(x - y) >= F.greatest(F.lit(0.2), 0.5 * F.abs(x)))
    holds = F.coalesce((F.col(low) <= null) & (F.col(high) >= null), F.lit(False))
    out = F.when(x.isNull() | y.isNull(), None).when((x - null) * (y - null) < 0, "contradicted").when(F.coalesce(far, F.lit(False)) | holds, "partial").otherwise("verified")
    return claims.withColumn("effect_verdict", out)


def extraction_confidence(claims: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds confidence: 0.15 and the weight of every field that is there, 1 at most."""
    found = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.15))
    return claims.withColumn("confidence", F.round(F.least(found, F.lit(1.0)), 4))
