"""Sentences of findings and their check, curation of notes, warnings, and checks of structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.operators import rules
from cohortlake.operators.longform import need, saved
from cohortlake.operators.rules import decided, low, mentions, size, words

# Sentences that a report must not show, words of a report's making, claims to soften and what stands for them.
BANNED = ["Now I have all the necessary information.", "Let me compile the comprehensive final report.", "Next step: run analyze", "Generated ... Fully deterministic, no LLM"]
SOFTENED = [("will improve survival", "could improve survival"), ("will reduce mortality", "could reduce mortality")]
OBSERVATIONAL = ["observational", "retrospective", "registry", "cohort"]
ADVISING = ["recommend", "should", "could", "future trial", "prospective", "test"]
# Subjects of notes, in the order in which one of each is sure of its place, with the words that tell them and their points.
SUBJECTS = [
    ("missingness", ["missing", "imput", "complete case"], 3), ("integrity", ["duplicate", "integrity", "inconsistent", "invalid"], 3), ("outliers", ["outlier", "extreme", "winsor", "skew", "heavy-tailed"], 2),
    ("digit_pref", ["digit preference", "rounding", "heaping"], 2), ("survival", ["censor", "follow-up", "followup", "time-to-event", "log-rank", "kaplan"], 3),
]
SMALL, SMALL_POINTS = ["small sample", "limited power", "underpowered"], 1
# How effects are shown.
SHOWN = {"odds_ratio": "OR", "hazard_ratio": "HR", "risk_ratio": "RR", "cramers_v": "Cramer's V", "cramer_v": "Cramer's V", "cohen_d": "Cohen's d", "mean_difference": "mean difference", "correlation": "correlation", "correlation_coefficient": "correlation"}
ENDPOINTS = {"mortality": "mortality", "survival": "survival", "primary_outcome": "the primary outcome"}
# Words that advise, that claim a cause, that tell a direction, and that name an endpoint.
ADVICE = ["should", "recommend", "consider", "need to", "important risk factor"]
CAUSES = ["cause", "causes", "caused", "lead to", "leads to", "result in", "results in", "drive", "drives", "prevent", "prevents", "protect", "protects", "improve", "improves"]
DIRECTIONS = ["higher", "lower", "increased", "decreased", "worse", "better", "risk"]
ENDPOINT_WORDS = ["mortality", "death", "survival", "follow-up"]
LONGEST = 220


def number(value: F.Column) -> F.Column:
    """Four decimals without trailing zeros; numbers below 0.001 in scientific form."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), r"0+$", ""), r"\.$", "")
    return F.when((value != 0) & (F.abs(value) < 0.001), F.format_string("%.2e", value)).otherwise(F.when(plain == "-0", "0").otherwise(plain))


def p_text(p: F.Column) -> F.Column:
    return F.when(p == 0, "p < 1e-12").when(p >= 0.9995, "p > 0.99").otherwise(F.concat(F.lit("p="), number(p)))


def _begun(text) -> F.Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def verbalised(findings: DataFrame) -> DataFrame:
    """Adds sentence from variable, endpoint, category, significant, direction, effect_label, effect, test, p, each of which may be null.

    Artifacts and notes are said to be such. Else: no association if not significant; if significant, who has more of the outcome, the
    direction of a ratio being its side of 1; without significance, that it was looked at. Effect, test and p stand in parentheses."""
    need(findings, "variable", "endpoint", "category", "significant", "direction", "effect_label", "effect", "test", "p")
    name = F.trim(F.replace(F.lower("variable"), F.lit("_"), F.lit(" ")))
    some = F.coalesce(name != "", F.lit(False))
    subject = F.when(some, _begun(name)).otherwise("This variable")
    outcome = F.lit("the outcome")
    for key, said in ENDPOINTS.items():
        outcome = F.when(F.col("endpoint") == key, said).otherwise(outcome)
    label = F.replace("effect_label", F.lit("_"), F.lit(" "))
    for key, said in SHOWN.items():
        label = F.when(F.lower("effect_label") == key, said).otherwise(label)
    shown = F.concat_ws(", ", F.when(F.col("effect_label").isNotNull() & F.col("effect").isNotNull(), F.concat_ws(" ", label, number(F.col("effect")))), F.when(F.col("p").isNotNull(), F.concat_ws(" ", F.nullif(F.trim("test"), F.lit("")), p_text(F.col("p")))))
    stats = F.when(shown == "", "").otherwise(F.concat(F.lit(" ("), shown, F.lit(")")))
    ratio = F.coalesce(F.col("effect_label").isin("odds_ratio", "hazard_ratio", "risk_ratio") & F.col("effect").isNotNull(), F.lit(False))
    way = F.when(ratio, F.when(F.col("effect") > 1, "positive").when(F.col("effect") < 1, "negative").otherwise("none")).otherwise(F.coalesce("direction", F.lit("unknown")))
    more = F.when(name == "age", "Older age").when(some, F.concat(F.lit("Higher "), name)).otherwise(subject)
    deaths = outcome == "mortality"
    text = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    positive = F.when(deaths & ratio & (F.col("effect_label") == "odds_ratio"), text(more, " was associated with higher odds of mortality", stats, "."))
    positive = positive.when(deaths & ratio & (F.col("effect_label") == "hazard_ratio"), text(more, " was associated with higher mortality hazard", stats, ".")).otherwise(text(more, " was associated with higher ", outcome, stats, "."))
    less = F.lower(subject)
    negative = F.when(deaths & ratio, text("Higher ", less, " was associated with lower odds of mortality", stats, ", consistent with lower ", less, " indicating higher mortality risk.")).otherwise(text(more, " was associated with lower ", outcome, stats, "."))
    said = (
        F.when(F.col("category") == "artifact_excluded", text(subject, " was excluded from analytical findings because it is an endpoint or derived endpoint-like variable."))
        .when((F.col("category") == "statistical_note") & (F.lower("variable") == "survival_primary"), text("The primary survival result was retained as a statistical note", stats, ", not as a baseline clinical predictor."))
        .when(F.col("category") == "statistical_note", text(subject, " was retained as a statistical note", stats, ", not as a primary clinical predictor."))
        .when(~F.col("significant"), text(subject, " was not significantly associated with ", outcome, stats, "."))
        .when(F.col("significant") & (way == "positive"), positive).when(F.col("significant") & (way == "negative"), negative)
        .when(F.col("significant"), text(subject, " was significantly associated with ", outcome, stats, "."))
        .otherwise(text(subject, " was evaluated for association with ", outcome, stats, "."))
    )
    return findings.withColumn("sentence", said)


def compared(findings: DataFrame) -> DataFrame:
    """Adds comparison, the plain claim of a finding (variable, endpoint, significant, direction, effect_label, effect) without its numbers: no
    significant association; higher risk of death with more or less of the variable; or an association with the outcome."""
    need(findings, "variable", "endpoint", "significant", "direction", "effect_label", "effect")
    name = F.trim(F.replace(F.lower(F.coalesce("variable", F.lit(""))), F.lit("_"), F.lit(" ")))
    subject = F.when(name != "", _begun(name)).otherwise("This variable")
    outcome = F.lit("the outcome")
    for key, said in ENDPOINTS.items():
        outcome = F.when(F.col("endpoint") == key, said).otherwise(outcome)
    ratio = F.coalesce(F.col("effect_label").isin("odds_ratio", "hazard_ratio", "risk_ratio") & F.col("effect").isNotNull(), F.lit(False))
    way = F.when(ratio, F.when(F.col("effect") > 1, "positive").when(F.col("effect") < 1, "negative").otherwise("none")).otherwise(F.coalesce("direction", F.lit("unknown")))
    side = F.when((name == "age") & (way == "positive"), "Older age").when((name != "") & (way == "positive"), F.concat(F.lit("Higher "), name)).when((name != "") & (way == "negative"), F.concat(F.lit("Lower "), name))
    text = lambda *parts: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))
    said = F.when(~F.col("significant"), text(subject, " did not show a statistically significant association with ", outcome, "."))
    said = said.when(F.col("significant") & side.isNotNull() & (F.col("endpoint") == "mortality"), text(side, " was associated with higher mortality risk."))
    said = said.when(F.col("significant") & side.isNotNull(), text(side, " was associated with ", outcome, ".")).otherwise(text(subject, " was significantly associated with ", outcome, "."))
    return findings.withColumn("comparison", said)


TEXTS = ["comparison_text", "plain_text", "text", "raw_text"]  # in order of preference


def comparable(findings: DataFrame, report: str, key: str) -> DataFrame:
    """The findings of each report that can be held against another report's, each text once.

    Rows have ``TEXTS``, of which the first that is not blank counts, source (grounded or corrected), category, variable, endpoint, significant, p, effect,
    ci_low, test, strength (0 to 100), strength_label and citations, all of which may be null. A category that the text belies gives way to the text's. What stays is
    analytical, of a type that is compared, not about an endpoint or a follow-up time itself; grounded rows must be eligible as sentences, corrected ones may
    be bare statistics if they have a variable and a number. Of equal texts of a report grounded ones come first, then the least key.

    Adds said, claim_type, evidence_score (strength by 100; 0.6 if only cited; else 0), evidence_label, extraction (how much of a test the row tells, 0 to 1).
    """
    need(findings, report, key, *TEXTS, "source", "category", "variable", "endpoint", "significant", "p", "effect", "ci_low", "test", "strength", "strength_label", "citations")
    said = F.coalesce(*(F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) for c in TEXTS), F.lit(""))
    rows = findings.withColumn("said", said).withColumn("_given", F.col("category")).drop("category")
    rows = saved(rules.gated(rules.categorised(rows, "said", "variable", "endpoint"), "said").drop("category_rules", "category_mask", "instruction"))
    analytical = lambda c: F.coalesce(F.col(c).isin(rules.ANALYTICAL_CATEGORIES), F.lit(False))
    whole = F.coalesce(F.trim("variable") != "", F.lit(False)) & (F.col("p").isNotNull() | F.col("effect").isNotNull() | F.col("significant").isNotNull()) & (F.col("source") == "corrected")
    given = F.when(whole & (F.col("_given") == "artifact_excluded"), "analytical").otherwise(F.coalesce("_given", "category"))
    seen = F.when(whole & (F.col("category") == "artifact_excluded"), "analytical").otherwise(F.col("category"))
    rows = rows.withColumn("_seen", seen).withColumn("_given", given)
    rows = rows.withColumn("category", F.when(analytical("_given") & ~analytical("_seen"), F.col("_seen")).otherwise(F.col("_given")))
    rows = saved(rules.typed(rows, "said", "variable", "significant", "p").drop("claim_type_rules", "claim_type_mask", "_given", "_seen"))
    broken = F.col("header") | F.col("raw_statistic") | F.col("fragment")
    itself = F.coalesce(rules.endpoint_like(F.col("variable")) | rules.follow_up_like(F.col("variable")), F.lit(False))
    fits = analytical("category") & F.col("claim_type").isin(rules.COMPARED_TYPES) & ~itself & F.when(F.col("source") == "grounded", F.col("eligible")).otherwise(~broken | whole)
    rows = rows.filter(fits).drop("header", "raw_statistic", "fragment", "eligible")
    score = F.when(F.col("strength").isNotNull(), F.col("strength") / 100).when(F.coalesce("citations", F.lit(0)) > 0, 0.6).otherwise(0.0)
    label = F.when(F.col("strength").isNotNull(), F.lower("strength_label")).when(F.coalesce("citations", F.lit(0)) > 0, "cited").otherwise("ungrounded")
    # fixed values: what each part of a reported test is worth; 0.1 for a report of one's own
    told = [("significant", 0.15), ("p", 0.25), ("effect", 0.25), ("ci_low", 0.15), ("test", 0.1)]
    extraction = reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), v).otherwise(0.0) for c, v in told)) + 0.1
    rows = rows.withColumn("evidence_score", score).withColumn("evidence_label", label).withColumn("extraction", F.least(extraction, F.lit(1.0)))
    first = rows.groupBy(F.col(report).alias("_report"), F.lower("said").alias("_said")).agg(F.min(F.struct((F.col("source") != "grounded").alias("late"), F.col(key).alias("key"))).alias("_first"))
    same = F.col(report).eqNullSafe(F.col("_report")) & (F.lower("said") == F.col("_said")) & (F.col(key) == F.col("_first.key")) & ((F.col("source") != "grounded") == F.col("_first.late"))
    return rows.join(first, same).drop("_report", "_said", "_first")


def checked(findings: DataFrame, sentence: str) -> DataFrame:
    """Adds violations, an array of what is wrong with a supplied sentence, and accepted, the sentence with blanks squeezed and a full stop if
    nothing is: it is one sentence of at most 220 characters, advises nothing, claims no cause, tells no direction that is unknown, names no endpoint
    where there is none, and does not contradict significance."""
    need(findings, sentence, "direction", "endpoint", "significant")
    clean = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(F.col(sentence), F.lit("")), r"\s+", " ")), r'^"+|"+$', "")
    lower = F.lower(clean)
    said = lambda phrases: lower.rlike(words(*phrases))
    parts = F.size(F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    tests = [
        ("empty", clean == ""),
        ("too long", F.length(clean) > LONGEST),
        ("several sentences", parts > 1),
        ("advice", said(ADVICE)),
        ("cause", said(CAUSES)),
        ("direction unknown", (F.coalesce("direction", F.lit("unknown")) == "unknown") & said(DIRECTIONS)),
        ("no such endpoint", F.col("endpoint").isNull() & said(ENDPOINT_WORDS)),
        ("claims significance", ~F.col("significant") & lower.contains("significant") & ~lower.contains("not")),
        ("denies significance", F.col("significant") & (lower.contains("did not show") | lower.contains("not significant"))),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests)))
    out = findings.withColumn("violations", found)
    return out.withColumn("accepted", F.when(F.size("violations") == 0, F.when(clean.rlike(r"[.!?]$"), clean).otherwise(F.concat(clean, F.lit(".")))))


def narration(line: F.Column) -> F.Column:
    """A line that tells of the report's making."""
    begin = [f"{a} {b}" for a in ("i will", "i will now", "i'm going to") for b in ("run", "analyze", "analyse", "compile", "generate")]
    return F.trim(line).isin(BANNED) | line.rlike(words("now i have", "let me compile", "let me summarize", "let me prepare", *begin)) | line.rlike(r"(?i)\bnext\s+step:") | line.rlike(r"(?i)^\s*>\s*generated\b.*\bdeterministic\b.*\bno\s+llm\b")


def told_plainly(text: F.Column) -> F.Column:
    """A text without empty lines and lines of narration."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: (F.trim(x) != "") & ~narration(x))
    return F.trim(F.array_join(kept, "\n"))


def cautious(text: F.Column, context: F.Column) -> F.Column:
    """``told_plainly`` with claims softened; advice from an observational study is marked as hypothesis-generating."""
    out = told_plainly(text)
    for claim, instead in SOFTENED:
        out = F.regexp_replace(out, words(claim), instead)
    marked = (out != "") & mentions(F.lower(F.coalesce(context, F.lit(""))), OBSERVATIONAL) & ~F.lower(out).contains("hypothesis-generating") & out.rlike(words(*ADVISING))
    return F.when(marked, F.concat(F.regexp_replace(out, r"\.+$", ""), F.lit(" (hypothesis-generating)."))).otherwise(out)


def curated(notes: DataFrame, report: str, key: str, text: str, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(kept, left out) of the notes of each report. Kept: texts without narration, each once (by its least key), first the best of each subject
    in order, then the best of the rest to ``most`` in all; better is more points, then the smaller key. The left out have a reason.

    Adds text (cleaned), subject, points, place. The same from any partitioning."""
    need(notes, report, key, text)
    lower = lambda c: F.lower(F.col(c))
    clean = notes.withColumn("_text", told_plainly(F.col(text)))
    points = reduce(lambda a, b: a + b, [F.when(mentions_anywhere(lower("_text"), told), value).otherwise(0) for _, told, value in SUBJECTS] + [F.when(mentions_anywhere(lower("_text"), SMALL), SMALL_POINTS).otherwise(0)])
    subjects = [(name, mentions_anywhere(lower("_text"), told), name) for name, told, _ in SUBJECTS]
    clean = decided(clean.withColumn("points", points), subjects, "subject", "other").drop("subject_rules", "subject_mask")
    # equal texts: a partial aggregate finds the least key before rows meet
    once = clean.filter("_text <> ''").groupBy(F.col(report).alias("_report"), low(F.col("_text")).alias("_same")).agg(F.min(key).alias("_first"))
    clean = clean.withColumn("_same", low(F.col("_text"))).join(once.withColumnRenamed("_same", "_s"), F.col(report).eqNullSafe(F.col("_report")) & (F.col("_same") == F.col("_s")), "left")
    reason = F.when(F.col("_text") == "", "narration").when(F.col(key) != F.col("_first"), "said before")
    clean = clean.withColumn("reason", reason).drop("_report", "_s", "_same", "_first")
    live = clean.filter("reason IS NULL")
    order = F.lit(len(SUBJECTS))
    for i, (name, _, _) in enumerate(SUBJECTS):
        order = F.when(F.col("subject") == name, i).otherwise(order)
    best = [F.desc("points"), F.col(key)]
    # each part keeps its own best first, so no window holds the notes of a large report
    live = live.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("_order", order)
    live = live.withColumn("_r", F.row_number().over(Window.partitionBy(report, "_part", "subject").orderBy(*best))).filter(F.col("_r") <= most)
    live = live.withColumn("_r", F.row_number().over(Window.partitionBy(report, "subject").orderBy(*best))).filter(F.col("_r") <= most)
    sure = (F.col("_r") == 1) & (F.col("_order") < len(SUBJECTS))
    live = live.withColumn("_place", F.struct(F.when(sure, F.col("_order")).otherwise(len(SUBJECTS)).alias("a"), (-F.when(sure, 0).otherwise(F.col("points"))).alias("b"), F.col(key).alias("c")))
    live = live.withColumn("place", F.row_number().over(Window.partitionBy(report).orderBy("_place"))).filter(F.col("place") <= most)
    names = [c for c in notes.columns if c != text]
    kept = live.select(*names, F.col("_text").alias(text), "subject", "points", "place")
    gone = clean.join(kept.select(F.col(report).alias("_report"), F.col(key).alias("_key")), F.col(report).eqNullSafe(F.col("_report")) & (F.col(key) == F.col("_key")), "left_anti")
    return kept, gone.select(*names, F.col("_text").alias(text), "subject", "points", F.coalesce("reason", F.lit("beyond the cap")).alias("reason"))


def mentions_anywhere(text: F.Column, parts: list[str]) -> F.Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def warned(findings: DataFrame, variable: str, missing: DataFrame, n_a: str, n_b: str, most: float = 30.0, least: int = 2) -> DataFrame:
    """Adds warnings, an array: a variable of which more than ``most`` percent is missing (from (variable, percent)), and fewer than ``least`` rows in a group."""
    need(findings, variable, n_a, n_b)
    m = missing.select(F.col("variable").alias("_v"), F.col("percent").alias("_missing"))
    out = findings.join(m, F.col(variable) == F.col("_v"), "left")
    high = F.when(F.col("_missing") > most, "Based on a column with high missingness — interpret with caution.")
    few = F.when(F.least(n_a, n_b) < least, "Sample size may be insufficient for this test.")
    return out.withColumn("warnings", F.array_compact(F.array(high, few))).drop("_v", "_missing")


def synthesis_errors(rows: DataFrame) -> DataFrame:
    """Adds errors, an array, to rows of a synthesis: kind (question, finding, recommendation, hypothesis, sample_size), text, source (of a
    question), status and citations (of a finding). Questions rest on four words at least; supported or contradicted findings cite; recommendations
    name a number; a hypothesis has more than ten words and is no placeholder; a sample size has a number or more than 20 characters."""
    need(rows, "kind", "text", "source", "status", "citations")
    t, kind = F.trim(F.coalesce("text", F.lit(""))), F.col("kind")
    digits = t.rlike("[0-9]")
    tests = [
        ("trivial source", (kind == "question") & (size(F.trim(F.coalesce("source", F.lit("")))) < 4)),
        ("no citations", (kind == "finding") & F.col("status").isin("Supported", "Contradicted") & (F.coalesce("citations", F.lit(0)) == 0)),
        ("no number", (kind == "recommendation") & ~digits),
        ("placeholder", (kind == "hypothesis") & ((size(t) <= 10) | (t == "Further investigation required."))),
        ("no sample size", (kind == "sample_size") & ~digits & (F.length(t) <= 20)),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in tests))))


def _strings(kind: T.DataType, at: F.Column, path: F.Column) -> F.Column | None:
    """array<struct<path, text>> of all strings below a value; null where its type holds none."""
    none = F.array().cast("array<struct<path:string,text:string>>")
    if isinstance(kind, T.StringType):
        return F.when(at.isNotNull(), F.array(F.struct(path.alias("path"), at.alias("text")))).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = [p for f in kind if (p := _strings(f.dataType, at.getField(f.name), F.concat(path, F.lit(f".{f.name}")))) is not None]
        return F.when(at.isNotNull(), F.concat(*parts)).otherwise(none) if parts else None
    if isinstance(kind, T.ArrayType):
        if _strings(kind.elementType, F.lit(None).cast(kind.elementType), path) is None:
            return None
        inner = F.flatten(F.transform(at, lambda x, i: _strings(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.coalesce(inner, none)
    if isinstance(kind, T.MapType):
        entry = kind.valueType
        if _strings(entry, F.lit(None).cast(entry), path) is None:
            return None
        inner = F.flatten(F.transform(F.map_entries(at), lambda e: _strings(entry, e.getField("value"), F.concat(path, F.lit("{"), e.getField("key").cast("string"), F.lit("}")))))
        return F.coalesce(inner, none)
    return None


def strings(df: DataFrame, key: str) -> DataFrame:
    """key, path, text: every string of every column, in structs, arrays and maps of any depth. The walk follows the schema, so it is one
    projection and one explode."""
    parts = [p for f in df.schema if f.name != key and (p := _strings(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name))) is not None]
    if not parts:
        return df.select(key, F.lit("").alias("path"), F.lit("").alias("text")).limit(0)
    return df.select(key, F.explode(F.concat(*parts)).alias("_s")).select(key, "_s.path", "_s.text")


def banned(df: DataFrame, key: str) -> DataFrame:
    """key, path, found: strings anywhere in a row that hold a banned phrase or narration, one row each."""
    t = F.lower("text")
    phrases = F.array(*(F.when(t.contains(b.lower()), F.lit(b)) for b in BANNED), F.when(narration(F.col("text")), F.lit("process_narration")), F.when(t.contains("treatment = death_event"), F.lit("treatment = DEATH_EVENT")))
    return strings(df, key).select(key, "path", F.explode(F.array_compact(phrases)).alias("found"))
