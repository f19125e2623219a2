"""Ordered rules over sentences: which rules hold is kept, the first of them decides. Categories and claim types of findings, and the
gates that keep headers, fragments and bare statistics out of a report. Every rule is a column, so all are read in one pass."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.longform import need, saved

# Phrases that tell what a sentence is about.
DATA_QUALITY = [
    "duplicate row", "duplicate key", "key-column duplicate", "key column duplicate", "repeated-row", "repeated row", "duplicate record", "record integrity", "record-integrity", "data integrity",
    "integrity check", "digit preference", "duplicate count", "constant column", "outlier", "baseline imbalance", "mcar", "missingness", "missing data",
]
PREPROCESSING = ["imputation", "imputed", "mice", "rubin", "listwise deletion", "rows dropped", "excluded from primary analysis", "preprocess", "pre-processing", "qubo", "feature selection", "feature-selector", "selected via", "selected using"]
WARNINGS = [
    "warning", "failed", "failure", "error", "skipped", "could not", "not provided", "requires", "insufficient configuration", "interpret with caution", "median survival: inf", "median survival = inf",
    "infinite median survival", "censoring", "censored", "survival analysis (time=", "event=",
]
CONTROL_NOTES = [
    "gate is open", "gate is closed", "hierarchical gate", "housekeeping", "setup", "configuration", "applicable", "ancova", "mmrm", "clda", "adjusted treatment p", "treatment-effect", "treatment effect",
    "normality", "shapiro", "kolmogorov", "anderson-darling", "test selection", "test-selection", "model selection", "study design", "study-design",
]
METADATA = [
    "dataset comprises", "dataset included", "dataset includes", "cohort comprised", "patients were included", "subjects were included", "study included", "trial included", "study design", "trial design",
    "baseline cohort", "cohort consisted", "patient characteristics", "predictor variables selected", "variables selected via", "variables selected using",
]
ANALYTICAL = ["associated", "association", "predict", "survival", "mortality", "death", "hazard ratio", "odds ratio", "risk ratio", "significant", "p=", "p <", "p<", "correlated"]
DESCRIPTIVE = ["event rate", "median survival", "overall survival", "median overall survival", "median follow up", "median follow-up", "follow-up duration", "follow up duration", "mean age", "baseline characteristics", "cohort summary", "proportion", "rate of"]
SYNTHETIC_ENDPOINTS = ["survival_primary", "survival_status", "mortality_flag", "event_flag", "death_event", "death event", "primary_endpoint", "primary_outcome"]
FOLLOW_UP = ["follow-up time", "follow up time", "followup time", "followup_time", "time-to-event", "time to event", "censoring time"]
INTERPRETED = ["associated with", "not associated", "did not show", "showed no", "predict", "higher", "lower", "increased risk", "decreased risk", "mortality risk", "survival"]
NORMALITY_WRAPPERS = ["all continuous variables are non-normal", "all continuous variables are non normal", "continuous variables rejected normality", "continuous variables reject normality"]
HEADER_HINTS = ["hazard", "ratio", "effect", "cohen", "bootstrap", "follow", "binary", "columns", "imputation", "rationale", "median survival"]
HEADERS = [
    "hazard ratio", "hazard ratios", "odds ratio", "odds ratios", "risk ratio", "risk ratios", "effect size", "effect sizes", "test selection rationale", "follow up", "binary outcome", "column", "columns", "imputation",
    "median survival", "continuous variable", "continuous variables", "categorical variable", "categorical variables", "cox regression", "logistic regression", "model summary", "statistical note", "statistical notes",
    "analytical findings", "data quality", "data quality note", "data quality notes", "result", "results", "method", "methods", "summary",
]
LABELS = [
    "interpretation", "event rate", "primary analysis result", "primary analysis results", "independent predictor", "independent predictors", "effect size", "study design", "dataset summary", "key statistical findings",
    "clinical analysis report", "statistical note", "statistical notes", "data quality note", "data quality notes",
]
ENDPOINT_NAMES = ["survival_primary", "survival_status", "survival_outcome", "the_survival_outcome", "mortality_flag", "event_flag", "death_event", "primary_endpoint", "primary_outcome"]
ENDPOINT_PARTS = ["mortality_flag", "event_flag", "survival_status", "survival_outcome"]
TIME_NAMES = ["time", "follow_up", "followup", "follow_up_time", "followup_time", "survival_time", "time_to_event", "censoring_time"]
# Categories that count as analytical, that are notes, and claim types that are compared.
ANALYTICAL_CATEGORIES = ["analytical", "clinical_association", "negative_association"]
NOTE_CATEGORIES = ["data_quality", "data_quality_note", "qc_note", "preprocessing", "statistical_note", "pipeline_warning"]
COMPARED_TYPES = ["association_claim", "analytical_association", "negative_association"]
NEUTRAL_STATUS = {"data_quality": "Data Quality Note", "data_quality_note": "Data Quality Note", "preprocessing": "Preprocessing Observation", "pipeline_warning": "Pipeline Warning"}

NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?"
COMPARED = r"(?:[<>]=?|=|≤|≥)"


def words(*phrases: str, ends: bool = True) -> str:
    """A pattern for any of the phrases as whole words, with any blanks between their words."""
    said = "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases)
    return rf"(?i)\b(?:{said})" + (r"\b" if ends else "")


def holds(text: F.Column, pattern: str) -> F.Column:
    return text.rlike(pattern)


def mentions(text: F.Column, phrases: list[str]) -> F.Column:
    """Whether a text in lower case has any of the phrases from the start of a word on, so that bilirubin is no rule of Rubin's."""
    return text.rlike("|".join(rf"\b{re.escape(p)}" for p in phrases))


def decided(df: DataFrame, rules: list[tuple[str, F.Column, F.Column | str]], into: str, otherwise: F.Column | str | None = None) -> DataFrame:
    """Adds ``into``, the result of the first rule (name, condition, result) that holds, ``into``_rules, the names of all that hold, in order,
    and ``into``_mask, the same as bits from the lowest on. A condition that is null does not hold."""
    names = [f"_rule{i}" for i in range(len(rules))]
    out = df.select("*", *(F.coalesce(c, F.lit(False)).alias(n) for n, (_, c, _) in zip(names, rules)))
    value = F.lit(otherwise) if not isinstance(otherwise, F.Column) else otherwise
    for n, (_, _, result) in reversed(list(zip(names, rules))):
        value = F.when(F.col(n), result if isinstance(result, F.Column) else F.lit(result)).otherwise(value)
    hit = F.array_compact(F.array(*(F.when(F.col(n), F.lit(name)) for n, (name, _, _) in zip(names, rules))))
    mask = reduce(lambda a, b: a + b, (F.when(F.col(n), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(names))).cast("long")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), value.alias(into), hit.alias(f"{into}_rules"), mask.alias(f"{into}_mask"))


# what single sentences show; every pattern is put together from words


def bare(text: F.Column) -> F.Column:
    """One line without the marks and numbers of lists, headings and bold around it; null reads as empty."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    line = F.regexp_replace(F.regexp_replace(line, r"^[ •-]+|[ •-]+$", ""), r"^(?:#{1,6} *|[0-9]+[.)] +)", "")
    return F.trim(F.regexp_replace(line, r"^(\*\*|__)(.*)\1$", "$2"))


def low(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def size(text: F.Column) -> F.Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


_ITEM = r"^\s*(?:[-*•]|[0-9]+[.)])?\s*"  # a list's mark, if any
_CHI = r"(?:χ\s*[²2]|chi\s*-?\s*square|chi2)"
_STAT = rf"(?:p|hr|or|rr|ci|auc|smd|{_CHI})"
_UNIT = r"(?:%|mg/dl|mmol/l|g/dl|ng/ml|u/l|iu/l|cm|mm|kg|bpm|mmhg|days?|months?|years?)"
_BEING = ["was", "were", "is", "are", "had", "has", "showed", "shows", "did", "does"]
_DOING = ["predict", "predicts", "predicted", "correlated", "differed", "increased", "decreased", "reduced", "lowered"]
_NAME = r"[a-z][a-z0-9_-]*(?:\s+[a-z][a-z0-9_-]*){0,5}"
_RELATIONS = [*_DOING, "associated", "association", "correlation", "differ", "difference", "higher", "lower", "greater", "less", "fewer", "significant", "show", "showed", "shows", "demonstrate", "demonstrates", "demonstrated", "odds", "hazard", "risk", "mortality", "survival", "outcome", "endpoint"]
_STRENGTH = ["", "strong ", "significant ", "statistically significant "]
_ADVERB = ["", "significantly ", "statistically ", "strongly "]
_CLINICAL = [
    *(f"{a}associated with" for a in _ADVERB), *(f"associated {a}with" for a in _ADVERB[1:]), "association with", "not associated", "not significantly associated",
    *(f"did not show {a}{s}association" for a in ("", "a ") for s in _STRENGTH[2:]), *(f"showed no {s}association" for s in _STRENGTH[2:]),
    *(f"{v} no {s}relationship" for v in ("show", "shows", "showed") for s in _STRENGTH), *(f"did not show {a}{s}relationship" for a in ("", "a ") for s in _STRENGTH), *(f"no {s}relationship with" for s in _STRENGTH),
    "predict", "predicts", "predicted", "predictor of", "predictors of", "correlated with", "positively correlated", "negatively correlated",
    *(f"{d} {a}{p}" for d in ("differ", "differs", "differed") for a in ("", "significantly ") for p in ("between", "in")),
    *(f"{v} {a}significant {p}" for v in ("was", "were") for a in ("", "statistically ", "significantly ") for p in ("for", "with", "in")),
    *(f"{v} {w}" for v in ("was", "were") for w in ("higher", "lower")), "increased", "decreased", "reduce", "reduces", "lowered", "raise", "raises", "raised",
    *(f"had {a}{b}{w}" for a in ("", "a ") for b in ("", "significantly ") for w in ("higher", "lower", "increased", "decreased", "reduced")),
]
_SIDES = [
    "mortality", "death", "deaths", "survival", "outcome", "endpoint", "risk", "odds", "hazard", "event", "patient who died", "patients who died", "survivor", "survivors", "nonsurvivor", "nonsurvivors",
    "group", "groups", "treatment arm", "control group", "compared with", "compared to", "between",
]
_END_NAMES = ["mortality", "death", "survival", "outcome", "endpoint"]
_THIS = rf"{_ITEM}(?:this|these|that|those)\s+(?:variable|factor|covariate|predictor)s?\b"


#: So many bytes of different texts at most are sent to every task with what they show; where there are more, rows are dealt evenly and read as they are.
MOST_BYTES = 32 << 20


def read(df: DataFrame, text: str) -> DataFrame:
    """Adds to each row what ``shown`` says of its text. Reading costs much more than moving a text, and tables of findings are small files that few
    tasks would read: so equal texts are read once, dealt to all tasks, or, if they differ too much, all rows are dealt to all tasks."""
    need(df, text)
    texts = df.select(F.col(text).alias("_said_text")).distinct()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = texts.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_said_text"), F.lit(0)).cast("long") + 100), F.lit(0))).first()[0]
    if total > MOST_BYTES:
        return shown(df.repartition(tasks), text)
    seen = saved(shown(texts.repartition(df.sparkSession.sparkContext.defaultParallelism), "_said_text"))
    return df.join(F.broadcast(seen), F.col(text).eqNullSafe(F.col("_said_text")), "left").drop("_said_text")


def shown(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_low`` (the text in lower case, blanks squeezed) and what it shows: ``_header``, ``_raw``, ``_fragment``, ``_instruction``,
    ``_eligible``, and ``_is_...`` for what it is about.

    - header: a heading or label, or nothing at all, rather than a finding;
    - raw: a variable with a chi-square and its p, and no word of what they mean;
    - fragment: fewer than four words, cut at either end, or a statistic without subject and verb, unless about data, preparation, checks or the study;
    - instruction: tells what to run, or names a method at the head of a line;
    - eligible: none of the first three, no label, bare statistic or note; it states a relation, has an outcome or groups, and its subject is a
      variable, or a variable of a group, or an outcome said to be related to one.

    Three projections, each of the columns before it: the text's forms, single patterns, and what follows from them.
    """
    need(df, text)
    own = [F.col(f"`{c}`") for c in df.columns]
    forms = df.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_raw_text"), bare(F.col(text)).alias("_t"))
    forms = forms.select(*own, "_raw_text", "_t", F.lower("_t").alias("_lower"), F.replace("_t", F.lit("_"), F.lit(" ")).alias("_said"), low(F.col("_raw_text")).alias("_low"), size(F.col("_t")).alias("_size"))
    t, lower, said, whole = F.col("_t"), F.col("_lower"), F.col("_said"), F.col("_low")
    names = "|".join(r"[-_\s]*".join(h.split()) for h in HEADERS)
    verbs = "|".join([*_BEING, "show", *_DOING, "reduce", "reduces", "raise", "raises", "raised"])
    ends, labels = "|".join(_END_NAMES), "|".join(x.replace(" ", r"\s+") for x in LABELS)
    adverb = r"(?:(?:significantly|statistically|strongly)\s+)?"
    method = r"(?:survival analysis|kaplan[- ]meier(?: curves?)?|cox regression|cox proportional hazards regression)\b"
    order = rf"^(?:please\s+)?(?:{'|'.join(('perform', 'run', 'conduct', 'use', 'apply'))})\b.*"
    cuts = ("vs", "versus", "compared with", "compared to", "relative to", "than")
    begun = "|".join(x.replace(" ", r"\s+") for x in (*cuts, "and", "or", "respectively", "whereas", "while"))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    single = {
        "is_preparation": mentions(whole, PREPROCESSING), "is_quality": mentions(whole, DATA_QUALITY), "is_warning": mentions(whole, WARNINGS), "is_follow_up": mentions(whole, FOLLOW_UP), "is_endpoint": mentions(whole, SYNTHETIC_ENDPOINTS),
        "is_control": mentions(whole, CONTROL_NOTES), "is_study": mentions(whole, METADATA), "is_analysis": mentions(whole, ANALYTICAL), "is_description": mentions(whole, DESCRIPTIVE), "interpreted": mentions(whole, INTERPRETED),
        "this": holds(t, f"(?i){_THIS}"), "named": holds(t, rf"(?i)^#*\s*[-*•]?\s*(?:\*\*|__)?\s*(?:{names})(?:\s*\([^)]*\))?\s*(?:\*\*|__)?\s*:?\s*$"), "wrapper": mentions(lower, NORMALITY_WRAPPERS),
        "tested": holds(lower, rf"\b(?:raw p|adjusted p|p)\s*{COMPARED}|\b(?:effect\s+size|or|hr|rr)\s*="), "verb": holds(t, words(*_BEING[:8], "show", "associated", *_DOING, "raise", "raises", "lowers")),
        "colon": F.endswith(t, F.lit(":")) & (size(F.rtrim(F.regexp_replace(t, ":+$", ""))) <= 10), "plain": holds(t, r"(?i)^(?:\*\*|__)?[a-z0-9 _/()%'.,-]+(?:\*\*|__)?$") & mentions(lower, HEADER_HINTS),
        "chi": holds(F.col("_raw_text"), rf"(?i){_ITEM}`?[a-z][a-z0-9_\s.-]{{0,80}}`?\s*[:;,-]?\s*(?:{_CHI}|x\s*\^?\s*2)\s*[=:]?\s*{NUMBER}.*\bp\s*{COMPARED}\s*{NUMBER}"),
        "subject": holds(t, rf"(?i)\b{_NAME}\s+(?:{'|'.join([*_BEING, *_DOING])})\b"), "related": holds(t, words(*_RELATIONS)),
        "cut": holds(t, words(*cuts, "between", "and", "or", ends=False) + r"\.?\s*$") | holds(t, r"[(\[{]\s*$") | (count("(") > count(")")) | (count("[") > count("]")) | holds(t, rf"(?i){_ITEM}(?:{begun})\b"),
        "bare": holds(t, rf"(?i){_ITEM}(?:{NUMBER}|{_STAT}\b)"), "statistic": holds(t, rf"(?i){_ITEM}(?:{NUMBER}\s*{_UNIT}?|{_STAT}\s*(?:{COMPARED}|:))"), "p": holds(t, rf"(?i)\bp(?:\s*[- ]?\s*value)?\s*{COMPARED}"),
        "stated": mentions(lower, ["significant", "associated", "correlat"]) | holds(lower, words("predict", "predicts", "predicted")),
        "order": holds(whole, order + words("analysis", "regression", "curve", "curves", "model", "models", "test", "tests", "kaplan-meier", "kaplan meier", "cox proportional hazards", "log-rank")) | holds(whole, rf"^{method}(?:\s*[:(,-]|\s+(?:with|including)\b)"),
        "passive": holds(said, rf"(?i){_ITEM}(?:{ends}|risk|odds|hazard|event)\s+(?:was|were|is|are)\s+{adverb}(?:associated|related|linked)\s+with\s+(?!p\s*{COMPARED})[a-z]"),
        "nameless": holds(t, rf"(?i){_ITEM}(?:\*\*|__)?\s*(?:no\s+association|association|relationship|difference|{ends})\b"),
        "label": holds(t, rf"(?i){_ITEM}(?:\*\*|__)?\s*(?:{labels}|characteristics\s+by\b[^:]*|prevalence\s+of\b[^:]*)\s*(?:\*\*|__)?\s*:"),
        "relation": holds(said, words(*_CLINICAL)), "sides": holds(said, words(*_SIDES) + r"|(?i)\bnon[- ]survivors?\b"),
        "variable": holds(t, rf"(?i){_ITEM}(?:\*\*|__)?\s*(?:each\s+[0-9.]+%?\s+increase\s+in\s+|higher|lower|elevated|reduced|older|younger)?\s*{_NAME}\s+(?:{verbs})\b"),
        "grouped": holds(said, words("patient who died", "patients who died", "survivor", "survivors", "nonsurvivors", "group", "groups") + r"|(?i)\bnon[- ]survivors?\b") & holds(t, r"(?i)\b(?:higher|lower|increased|decreased|reduced|elevated)\s+[a-z]"),
    }
    seen = forms.select(*own, "_low", "_size", (F.col("_t") == "").alias("_empty"), *(c.alias(f"_{n}") for n, c in single.items()))
    of = lambda n: F.col(f"_{n}")
    short, claim = of("size") <= 8, of("subject") & of("related")
    about = of("is_preparation") | of("is_quality") | of("is_control") | of("is_study")
    header = of("empty") | of("this") | of("named") | of("wrapper") | (~of("tested") & ~of("verb") & (of("colon") | (of("plain") & short)))
    broken = of("cut") | (of("bare") & (of("size") <= 12) & ~of("subject")) | (of("statistic") & ~of("subject")) | ((of("p") | of("stated")) & ~claim)
    fragment = of("empty") | (of("size") < 4) | (~about & broken)
    kinds = [f"_{n}" for n in single if n.startswith("is_")]
    kept = seen.select(*own, "_low", *kinds, header.alias("_header"), (of("chi") & ~of("interpreted")).alias("_raw"), fragment.alias("_fragment"), of("order").alias("_instruction"),
                       (~of("label") & ~of("bare") & ~of("statistic") & ~(of("nameless") & ~of("passive")) & ~of("is_study") & ~of("is_preparation") & ~of("is_control") & ~(of("is_description") & ~of("relation")) & of("relation") & of("sides") & (of("variable") | of("grouped") | of("passive"))).alias("_fit"))
    return kept.withColumn("_eligible", F.col("_fit") & ~F.col("_header") & ~F.col("_raw") & ~F.col("_fragment")).drop("_fit")


def endpoint_like(variable: F.Column) -> F.Column:
    name = F.replace(F.trim(F.regexp_replace(F.lower(F.replace(variable, F.lit("_"), F.lit(" "))), r"\s+", " ")), F.lit(" "), F.lit("_"))
    return name.isin(ENDPOINT_NAMES) | name.rlike("|".join(ENDPOINT_PARTS))


def follow_up_like(variable: F.Column) -> F.Column:
    return F.regexp_replace(F.trim(F.lower(variable)), "[- ]", "_").isin(TIME_NAMES)


def _without(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_is_")), "_low", "_header", "_raw", "_fragment", "_instruction", "_eligible")


def categorised(findings: DataFrame, text: str, variable: str, endpoint: str) -> DataFrame:
    """Adds category, one of 12, with category_rules and category_mask. variable and endpoint may be null; a null text is a header."""
    need(findings, text, variable, endpoint)
    v, e = F.col(variable), F.col(endpoint)
    same = F.lower(F.trim(v)) == F.lower(F.trim(e))
    rules = [
        ("header", F.col("_header") & (F.col("_low") != ""), "statistical_note"),
        ("raw statistic", F.col("_raw"), "statistical_note"),
        ("preparation", F.col("_is_preparation"), "preprocessing"),
        ("data quality", F.col("_is_quality"), "data_quality_note"),
        ("warning", F.col("_is_warning"), "statistical_note"),
        ("follow-up", F.col("_is_follow_up"), "statistical_note"),
        ("endpoint itself", F.col("_is_endpoint") & same, "artifact_excluded"),
        ("endpoint's name", F.col("_is_endpoint"), "statistical_note"),
        ("instruction", F.col("_instruction"), "qc_note"),
        ("control", F.col("_is_control"), "qc_note"),
        ("study", F.col("_is_study"), "qc_note"),
        ("fragment", F.col("_fragment"), "artifact_excluded"),
        ("variable is the endpoint", same | endpoint_like(v), "artifact_excluded"),
        ("variable is a time", follow_up_like(v), "statistical_note"),
        ("variable", v.isNotNull() & (v != ""), "analytical"),
        ("survival", (e == "survival") | F.col("_low").contains("survival"), "survival_result"),
        ("endpoint", e.isin("mortality", "primary_outcome"), "endpoint_result"),
        ("analysis", F.col("_is_analysis"), "analytical"),
    ]
    return _without(decided(read(findings, text), rules, "category", "qc_note"))


def typed(findings: DataFrame, text: str, variable: str, significant: str, p: str, category: str = "category") -> DataFrame:
    """Adds claim_type, with claim_type_rules and claim_type_mask, from the category, the text, and what is known of significance."""
    need(findings, text, variable, significant, p, category)
    c, known = F.col(category), F.col(variable).isNotNull() & (F.col(significant).isNotNull() | F.col(p).isNotNull())
    share = holds(F.col("_low"), r"\b[0-9]+(?:\.[0-9]+)?%") & ~mentions(F.col("_low"), ["significant", "associated", "predict", "hazard ratio", "odds ratio"])
    rules = [
        ("artifact", c == "artifact_excluded", "artifact"),
        ("study", F.col("_is_study"), "metadata_claim"),
        ("description", F.col("_is_description"), "descriptive_context"),
        ("share", share, "descriptive_context"),
        ("data", c.isin("data_quality", "data_quality_note", "preprocessing"), "data_quality_note"),
        ("statistical note", c == "statistical_note", "statistical_note"),
        ("setup", c.isin("pipeline_warning", "qc_note"), "setup_claim"),
        ("not significant", known & ~F.col(significant), "negative_association"),
        ("tested", known, "analytical_association"),
        ("analysis", F.col("_is_analysis"), "association_claim"),
    ]
    return _without(decided(read(findings, text), rules, "claim_type", "descriptive_claim"))


def gated(findings: DataFrame, text: str) -> DataFrame:
    """Adds header, raw_statistic, fragment, instruction, eligible of each text, as ``read`` says them."""
    shown = {"header": "_header", "raw_statistic": "_raw", "fragment": "_fragment", "instruction": "_instruction", "eligible": "_eligible"}
    return read(findings, text).select(*(F.col(f"`{c}`") for c in findings.columns), *(F.col(c).alias(n) for n, c in shown.items()))


def neutral_status(category: F.Column) -> F.Column:
    out = F.lit("QC Observation")
    for name, status in NEUTRAL_STATUS.items():
        out = F.when(category == name, status).otherwise(out)
    return out


def sanitised(findings: DataFrame, text: str, category: str = "category") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, notes, excluded): analytical findings whose text is eligible; notes, and analytical rows whose text is a header or a bare statistic,
    which are demoted to notes; everything else, with its reason. Every row is in exactly one of the three."""
    need(findings, text, category)
    c = F.col(category)
    analytical = c.isin(ANALYTICAL_CATEGORIES)
    rules = [
        ("analytical and eligible", analytical & F.col("_eligible"), "kept"),
        ("note", c.isin(NOTE_CATEGORIES), "note"),
        ("header", analytical & F.col("_header"), "note"),
        ("raw statistic", analytical & F.col("_raw"), "note"),
        ("fragment", F.col("_fragment"), "excluded"),
        ("artifact", c == "artifact_excluded", "excluded"),
    ]
    out = _without(decided(read(findings, text), rules, "fate", "excluded"))
    reason = F.coalesce(F.try_element_at("fate_rules", F.lit(1)), F.lit("states no relation of a variable"))
    out = saved(out.withColumn("reason", reason).drop("fate_rules", "fate_mask"))  # read once; three outputs
    notes = out.filter("fate = 'note'").withColumn(category, F.when(analytical, "statistical_note").otherwise(c))
    return (out.filter("fate = 'kept'").drop("fate", "reason"), notes.withColumn("status", neutral_status(F.col(category))).drop("fate", "reason"), out.filter("fate = 'excluded'").drop("fate"))
