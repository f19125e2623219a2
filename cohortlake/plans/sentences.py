"""Queries over report sentences built from the tables, with many wordings; the SQL holds what each wording is, in plain words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import curation, profile, rules
from cohortlake.plans.queries import query, rounded, table

#: A wording ({v}: a variable, {k}: a number), variable given or not, endpoint, and what it is: category, claim type, header, raw statistic, fragment, eligible.
WORDINGS = [
    ("{v} was significantly associated with mortality (p = 0.0{k}).", 1, "mortality", "analytical", "analytical_association", 0, 0, 0, 1),
    ("Higher {v} predicted death at {k} months in this group.", 1, "mortality", "analytical", "analytical_association", 0, 0, 0, 1),
    ("{v} did not show a significant association with survival after {k} visits.", 1, "survival", "analytical", "analytical_association", 0, 0, 0, 1),
    ("Mortality was associated with {v} in stratum {k}.", 0, "mortality", "endpoint_result", "association_claim", 0, 0, 0, 1),
    ("Survival differed between the arms at visit {k}.", 0, None, "survival_result", "association_claim", 0, 0, 0, 0),
    ("`{v}`: chi-square = {k}.4, p = 0.0021", 1, "mortality", "statistical_note", "statistical_note", 0, 1, 1, 0),
    ("- {v}, chi2 {k}.75; p < .001", 1, "mortality", "statistical_note", "statistical_note", 0, 1, 1, 0),
    ("## Odds Ratios", 0, None, "statistical_note", "statistical_note", 1, 0, 1, 0),
    ("**Cox regression:**", 0, None, "statistical_note", "statistical_note", 1, 0, 1, 0),
    ("Effect size for {v}, site {k}", 0, None, "statistical_note", "statistical_note", 1, 0, 0, 0),
    ("These variables entered step {k} of the model", 0, None, "statistical_note", "statistical_note", 1, 0, 0, 0),
    ("Values of {v} were imputed {k} times.", 0, None, "preprocessing", "data_quality_note", 0, 0, 0, 0),
    ("{k} duplicate rows were removed from the table.", 0, None, "data_quality_note", "data_quality_note", 0, 0, 0, 0),
    ("Digit preference was seen in {v} at site {k}.", 0, None, "data_quality_note", "data_quality_note", 0, 0, 0, 0),
    ("The model for {v} failed at step {k} of the run.", 0, None, "statistical_note", "statistical_note", 0, 0, 0, 0),
    ("Median follow-up time was {k} months for all subjects.", 0, None, "statistical_note", "descriptive_context", 0, 0, 0, 0),
    ("Please run a Kaplan-Meier curve for {v} by arm {k}.", 0, None, "qc_note", "setup_claim", 0, 0, 0, 0),
    ("The hierarchical gate is closed for {v}, family {k}.", 0, None, "qc_note", "setup_claim", 0, 0, 0, 0),
    ("The dataset comprises {k} women and men.", 0, None, "qc_note", "metadata_claim", 0, 0, 0, 0),
    ("Versus arm {k}, {v} had more events", 0, None, "artifact_excluded", "artifact", 0, 0, 1, 0),
    ("{v} was lower in arm {k} compared with", 0, None, "artifact_excluded", "artifact", 0, 0, 1, 0),
    ("p = 0.0{k} for trend over the doses", 0, None, "artifact_excluded", "artifact", 0, 0, 1, 0),
    ("Bilirubin of {v} was higher in patients who died at site {k}.", 0, None, "qc_note", "setup_claim", 0, 0, 0, 1),
    ("Patients who died had higher {v} at visit {k}.", 0, None, "qc_note", "setup_claim", 0, 0, 0, 1),
    ("In arm {k} some {v} was seen now and then.", 0, None, "qc_note", "setup_claim", 0, 0, 0, 0),
    ("Of all subjects {k} left before visit two.", 0, "mortality", "endpoint_result", "descriptive_claim", 0, 0, 0, 0),
]
_KIND = "p_partkey % {n}".format(n=len(WORDINGS))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence a part: its wording by its key, its variable and number from its columns."""
    name = F.concat(F.lit("marker_"), (F.col("p_partkey") % 37).cast("string"))
    text, variable, endpoint = F.lit(None), F.lit(None), F.lit(None)
    for i, (said, given, outcome, *_) in enumerate(WORDINGS):
        mine = F.col("p_partkey") % len(WORDINGS) == i
        text = F.when(mine, F.replace(F.replace(F.lit(said), F.lit("{v}"), name), F.lit("{k}"), F.col("p_size").cast("string"))).otherwise(text)
        variable = F.when(mine, name if given else F.lit(None)).otherwise(variable)
        endpoint = F.when(mine, F.lit(outcome)).otherwise(endpoint)
    p = F.when(variable.isNotNull(), F.col("p_size") / 1000)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), variable.cast("string").alias("variable"), endpoint.cast("string").alias("endpoint"), F.lit(None).cast("boolean").alias("significant"), p.alias("p"))


def _values(*places: int) -> str:
    def said(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join(f"({i}, {', '.join(said(w[k]) for k in places)})" for i, w in enumerate(WORDINGS))


@query(
    "finding_categories",
    f"""SELECT p_partkey, category, claim_type, count(*) OVER (PARTITION BY category, claim_type) AS alike
FROM part JOIN (VALUES {_values(3, 4)}) w(kind, category, claim_type) ON {_KIND} = kind""",
)
def finding_categories(spark, sf_dir):
    out = rules.typed(rules.categorised(sentences(spark, sf_dir), "text", "variable", "endpoint"), "text", "variable", "significant", "p")
    alike = out.groupBy("category", "claim_type").agg(F.count(F.lit(1)).alias("alike"))
    return out.select("p_partkey", "category", "claim_type").join(F.broadcast(alike), ["category", "claim_type"])  # a row a pair of kinds


@query(
    "finding_gates",
    f"""SELECT p_partkey, header = 1 AS header, raw_statistic = 1 AS raw_statistic, fragment = 1 AS fragment, eligible = 1 AS eligible
FROM part JOIN (VALUES {_values(5, 6, 7, 8)}) w(kind, header, raw_statistic, fragment, eligible) ON {_KIND} = kind""",
)
def finding_gates(spark, sf_dir):
    return rules.gated(sentences(spark, sf_dir), "text").select("p_partkey", "header", "raw_statistic", "fragment", "eligible")


@query(
    "finding_fates",
    f"""
SELECT CASE WHEN category = 'analytical' AND eligible = 1 THEN 'kept' WHEN category IN ('data_quality_note', 'qc_note', 'preprocessing', 'statistical_note') THEN 'note' ELSE 'excluded' END AS fate, category,
    CASE WHEN category = 'analytical' THEN NULL WHEN category = 'data_quality_note' THEN 'Data Quality Note' WHEN category = 'preprocessing' THEN 'Preprocessing Observation' WHEN category IN ('qc_note', 'statistical_note') THEN 'QC Observation' END AS status,
    count(*) AS n
FROM part JOIN (VALUES {_values(3, 8)}) w(kind, category, eligible) ON {_KIND} = kind GROUP BY ALL""",
)
def finding_fates(spark, sf_dir):
    """What is kept, what becomes a note, what is left out."""
    kept, notes, gone = rules.sanitised(rules.categorised(sentences(spark, sf_dir), "text", "variable", "endpoint"), "text")
    none = F.lit(None).cast("string")
    out = kept.select(F.lit("kept").alias("fate"), "category", none.alias("status")).unionByName(notes.select(F.lit("note").alias("fate"), "category", "status")).unionByName(gone.select(F.lit("excluded").alias("fate"), "category", none.alias("status")))
    return out.groupBy("fate", "category", "status").agg(F.count(F.lit(1)).alias("n"))


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of parts: effect, p and significance from price and size."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 11 = 0 THEN 'age' WHEN p_partkey % 11 = 1 THEN 'survival_primary' ELSE 'serum_marker' END AS variable", "CASE WHEN p_partkey % 3 = 0 THEN 'mortality' WHEN p_partkey % 3 = 1 THEN 'primary_outcome' END AS endpoint",
        "CASE WHEN p_partkey % 11 = 1 THEN 'statistical_note' WHEN p_partkey % 13 = 2 THEN 'artifact_excluded' ELSE 'analytical' END AS category", "CASE WHEN p_partkey % 5 > 0 THEN p_size < 25 END AS significant",
        "CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_size % 2 = 0 THEN 'positive' ELSE 'negative' END AS direction", "CASE WHEN p_partkey % 4 = 0 THEN 'odds_ratio' WHEN p_partkey % 4 = 1 THEN 'hazard_ratio' ELSE 'cohen_d' END AS effect_label",
        "p_size / 20.0D AS effect", "CASE WHEN p_partkey % 2 = 0 THEN 'chi_square' ELSE '' END AS test", "CASE WHEN p_partkey % 6 > 0 THEN p_size / 500.0D END AS p")


@query(
    "finding_sentences",
    r"""
WITH f AS (
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'age' WHEN p_partkey % 11 = 1 THEN 'survival_primary' ELSE 'serum marker' END AS v,
        CASE p_partkey % 3 WHEN 0 THEN 'mortality' WHEN 1 THEN 'the primary outcome' ELSE 'the outcome' END AS o, CASE WHEN p_partkey % 5 > 0 THEN p_size < 25 END AS sig,
        CASE p_partkey % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'HR' ELSE 'Cohen''s d' END AS label, p_size / 20.0 AS e, p_size,
        CASE WHEN p_partkey % 4 < 2 THEN CASE WHEN p_size > 20 THEN 1 WHEN p_size < 20 THEN -1 ELSE 0 END WHEN p_partkey % 7 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS way,
        CASE WHEN p_partkey % 6 > 0 THEN p_size / 500.0 END AS p FROM part),
s AS (
    SELECT *, ' (' || label || ' ' || CAST(CAST(e AS DECIMAL(9, 2)) AS DOUBLE)::VARCHAR || CASE WHEN p IS NULL THEN '' ELSE ', ' || CASE WHEN p_partkey % 2 = 0 THEN 'chi_square ' ELSE '' END || 'p=' || CAST(CAST(p AS DECIMAL(9, 3)) AS DOUBLE)::VARCHAR END || ')' AS raw,
        CASE WHEN v = 'age' THEN 'Age' WHEN v = 'survival_primary' THEN 'Survival primary' ELSE 'Serum marker' END AS subject,
        CASE WHEN v = 'age' THEN 'Older age' ELSE 'Higher ' || replace(v, '_', ' ') END AS more FROM f),
t AS (SELECT *, regexp_replace(raw, '\.0([,)])', '\1', 'g') AS stats FROM s)
SELECT p_partkey, CASE
    WHEN p_partkey % 11 = 1 THEN 'The primary survival result was retained as a statistical note' || stats || ', not as a baseline clinical predictor.'
    WHEN p_partkey % 13 = 2 THEN subject || ' was excluded from analytical findings because it is an endpoint or derived endpoint-like variable.'
    WHEN sig IS NULL THEN subject || ' was evaluated for association with ' || o || stats || '.'
    WHEN NOT sig THEN subject || ' was not significantly associated with ' || o || stats || '.'
    WHEN way = 0 THEN subject || ' was significantly associated with ' || o || stats || '.'
    WHEN way = 1 AND o = 'mortality' AND label = 'OR' THEN more || ' was associated with higher odds of mortality' || stats || '.'
    WHEN way = 1 AND o = 'mortality' AND label = 'HR' THEN more || ' was associated with higher mortality hazard' || stats || '.'
    WHEN way = 1 THEN more || ' was associated with higher ' || o || stats || '.'
    WHEN o = 'mortality' AND label IN ('OR', 'HR') THEN 'Higher ' || lower(subject) || ' was associated with lower odds of mortality' || stats || ', consistent with lower ' || lower(subject) || ' indicating higher mortality risk.'
    ELSE more || ' was associated with lower ' || o || stats || '.' END AS sentence
FROM t""",
)
def finding_sentences(spark, sf_dir):
    return curation.verbalised(tested(spark, sf_dir)).select("p_partkey", "sentence")


_SUPPLIED = [
    ("Higher marker was associated with the outcome", "direction unknown"), ("Marker should be measured. It is cheap.", "several sentences,advice"), ("The marker causes harm in arm {k}.", "cause"),
    ("The marker rose with mortality at visit {k}.", "no such endpoint"), ("The marker was significant at site {k}.", "claims significance"), ("  The   marker moved at site {k} ", ""), ("", "empty"), ("x" * 221, "too long"),
]


@query(
    "sentence_checks",
    "SELECT p_partkey, violations, CASE WHEN violations = '' THEN 'The marker moved at site ' || p_size || '.' END AS accepted FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{v}')" for i, (_, v) in enumerate(_SUPPLIED))
    + f") w(kind, violations) ON p_partkey % {len(_SUPPLIED)} = kind",
)
def sentence_checks(spark, sf_dir):
    text = F.lit(None)
    for i, (said, _) in enumerate(_SUPPLIED):
        text = F.when(F.col("p_partkey") % len(_SUPPLIED) == i, F.replace(F.lit(said), F.lit("{k}"), F.col("p_size").cast("string"))).otherwise(text)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("said"), none.alias("direction"), none.alias("endpoint"), F.lit(False).alias("significant"))
    return curation.checked(rows, "said").select("p_partkey", F.array_join("violations", ",").alias("violations"), "accepted")


_NOTES = [("{k} values are missing for {v}.", 0, 3), ("A duplicate of {v} was found {k} times.", 1, 3), ("Outlier in {v}: {k}.", 2, 2), ("Heaping at {k} in {v}.", 3, 2), ("Subjects were censored at {k}.", 4, 3), ("{v} was seen {k} times, a small sample.", 9, 1), ("Let me compile {v} for {k}.", None, None)]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on parts, a report a manufacturer's brand; equal texts occur."""
    text = F.lit(None)
    for i, (said, _, _) in enumerate(_NOTES):
        text = F.when(F.col("p_partkey") % len(_NOTES) == i, F.replace(F.replace(F.lit(said), F.lit("{k}"), (F.col("p_size") % 9).cast("string")), F.lit("{v}"), F.lit("the marker"))).otherwise(text)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("report"), "p_partkey", text.alias("text"))


@query(
    "curated_notes",
    f"""
WITH n AS (SELECT p_brand AS report, p_partkey, p_size % 9 AS k, kind, place, points FROM part JOIN (VALUES {", ".join(f"({i}, {p}, {q})" for i, (_, p, q) in enumerate(_NOTES) if p is not None)}) w(kind, place, points) ON p_partkey % {len(_NOTES)} = kind),
u AS (SELECT report, min(p_partkey) AS p_partkey, place, points FROM n GROUP BY report, k, kind, place, points),
r AS (SELECT *, place < 9 AND row_number() OVER (PARTITION BY report, place ORDER BY points DESC, p_partkey) = 1 AS sure FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE WHEN sure THEN place ELSE 9 END, CASE WHEN sure THEN 0 ELSE -points END, p_partkey) AS rank FROM r)
SELECT report, p_partkey, rank AS place, points FROM o WHERE rank <= 12""",
)
def curated_notes(spark, sf_dir):
    kept, _ = curation.curated(notes(spark, sf_dir), "report", "p_partkey", "text")
    return rounded(kept.select("report", "p_partkey", "place", "points"))


@query(
    "banned_text",
    """
SELECT p_partkey, 'body.lines[' || (p_size % 3) || ']' AS path, 'process_narration' AS found FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_partkey, 'body.title', 'Next step: run analyze' FROM part WHERE p_partkey % 10 = 3
UNION ALL SELECT p_partkey, 'body.title', 'process_narration' FROM part WHERE p_partkey % 10 = 3
UNION ALL SELECT p_partkey, 'extra{note}', 'treatment = DEATH_EVENT' FROM part WHERE p_partkey % 14 = 5""",
)
def banned_text(spark, sf_dir):
    """Strings in structs, arrays and maps of rows shaped like reports."""
    line = F.when(F.col("p_partkey") % 6 == 0, "Now I have what I need.").otherwise("Nothing of note.")
    lines = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("p_size") % 3, line).otherwise(F.lit("plain")))
    title = F.when(F.col("p_partkey") % 10 == 3, "next step: run ANALYZE now").otherwise(F.col("p_brand"))
    extra = F.create_map(F.lit("note"), F.when(F.col("p_partkey") % 14 == 5, "Treatment = death_event").otherwise(F.lit(None)), F.lit("size"), F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(lines.alias("lines"), title.alias("title"), F.col("p_size").alias("n")).alias("body"), extra.alias("extra"))
    return curation.banned(rows, "p_partkey")


@query(
    "structure_errors",
    """
SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'trivial source' WHEN 2 THEN 'no citations' WHEN 5 THEN 'no number' WHEN 6 THEN 'placeholder' WHEN 8 THEN 'no sample size' ELSE '' END AS errors FROM part""",
)
def structure_errors(spark, sf_dir):
    shapes = [
        ("question", "Why?", "too short", None, None), ("question", "Why?", "the marker fell by visit", None, None), ("finding", "x", None, "Supported", 0), ("finding", "x", None, "Novel", 0), ("recommendation", "Enrol {k} more.", None, None, None),
        ("recommendation", "Enrol more.", None, None, None), ("hypothesis", "Further investigation required.", None, None, None), ("hypothesis", "a b c d e f g h i j k", None, None, None), ("sample_size", "some", None, None, None), ("sample_size", "as many as the pilot had", None, None, None),
    ]
    columns = []
    for place, name in enumerate(("kind", "text", "source", "status")):
        c = F.lit(None).cast("string")
        for i, shape in enumerate(shapes):
            c = F.when(F.col("p_partkey") % 10 == i, F.replace(F.lit(shape[place]), F.lit("{k}"), F.col("p_size").cast("string"))).otherwise(c)
        columns.append(c.alias(name))
    rows = table(spark, sf_dir, "part").select("p_partkey", *columns, F.when(F.col("p_partkey") % 10 < 4, 0).alias("citations"))
    return curation.synthesis_errors(rows).select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query(
    "finding_warnings",
    """
WITH m AS (SELECT 100.0 * count(*) FILTER (l_orderkey % 7 = 0) / count(*) AS quantity, 100.0 * count(*) FILTER (l_partkey % 5 <= 1) / count(*) AS price FROM lineitem)
SELECT p_partkey, concat_ws(' ', CASE WHEN CASE WHEN p_partkey % 2 = 0 THEN quantity ELSE price END > 30 THEN 'Based on a column with high missingness — interpret with caution.' END,
    CASE WHEN p_size < 2 THEN 'Sample size may be insufficient for this test.' END) AS warnings FROM part, m""",
)
def finding_warnings(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity", "CASE WHEN l_partkey % 5 > 1 THEN l_extendedprice END AS price")
    missing = profile.missingness(lines, ["quantity", "price"])
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "IF(p_partkey % 2 = 0, 'quantity', 'price') AS variable", "p_size AS n_a", "100 AS n_b")
    return curation.warned(rows, "variable", missing, "n_a", "n_b").select("p_partkey", F.array_join("warnings", " ").alias("warnings"))


@query(
    "comparison_sentences",
    """
WITH f AS (
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'age' WHEN p_partkey % 11 = 1 THEN 'survival primary' ELSE 'serum marker' END AS v, p_partkey % 3 AS o, CASE WHEN p_partkey % 5 > 0 THEN p_size < 25 END AS sig,
        CASE WHEN p_partkey % 4 < 2 THEN sign(p_size - 20) WHEN p_partkey % 7 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS way FROM part),
s AS (SELECT *, CASE WHEN way = 1 AND v = 'age' THEN 'Older age' WHEN way = 1 THEN 'Higher ' || v WHEN way = -1 THEN 'Lower ' || v END AS side, upper(v[1]) || v[2:] AS subject, CASE o WHEN 0 THEN 'mortality' WHEN 1 THEN 'the primary outcome' ELSE 'the outcome' END AS outcome FROM f)
SELECT p_partkey, CASE WHEN NOT sig THEN subject || ' did not show a statistically significant association with ' || outcome || '.' WHEN sig AND side IS NOT NULL AND o = 0 THEN side || ' was associated with higher mortality risk.'
    WHEN sig AND side IS NOT NULL THEN side || ' was associated with ' || outcome || '.' ELSE subject || ' was significantly associated with ' || outcome || '.' END AS comparison FROM s""",
)
def comparison_sentences(spark, sf_dir):
    return curation.compared(tested(spark, sf_dir)).select("p_partkey", "comparison")


@query(
    "comparable_findings",
    f"""
WITH r AS (
    SELECT p_brand AS report, p_partkey, p_partkey % 3 = 0 AS late, kind, p_partkey % 37 AS v, p_size AS k, CASE WHEN p_partkey % 4 = 1 THEN p_size * 2.0 / 100 WHEN p_partkey % 4 = 2 THEN 0.6 ELSE 0 END AS score,
        CASE WHEN p_partkey % 4 = 1 THEN 'weak' WHEN p_partkey % 4 = 2 THEN 'cited' ELSE 'ungrounded' END AS label
    FROM part JOIN (VALUES {_values(3, 8)}) w(kind, category, eligible) ON {_KIND} = kind WHERE category = 'analytical' AND eligible = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY report, kind, v, k ORDER BY late, p_partkey) AS i FROM r)
SELECT report, p_partkey, 'analytical_association' AS claim_type, score AS evidence_score, label AS evidence_label, CAST(0.35 AS DOUBLE) AS extraction FROM u WHERE i = 1""",
)
def comparable_findings(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("report"), "p_size")
    none = lambda kind: F.lit(None).cast(kind)
    rows = sentences(spark, sf_dir).join(part, "p_partkey").select(
        "report", "p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("text")).otherwise(F.lit("  ")).alias("comparison_text"), F.when(F.col("p_partkey") % 5 == 1, F.col("text")).alias("plain_text"), F.when(F.col("p_partkey") % 5 > 1, F.col("text")).alias("text"), F.lit("raw words").alias("raw_text"),
        F.when(F.col("p_partkey") % 3 == 0, "corrected").otherwise("grounded").alias("source"), F.lit("analytical").alias("category"), "variable", "endpoint", "significant", "p", none("double").alias("effect"), none("double").alias("ci_low"), none("string").alias("test"),
        F.when(F.col("p_partkey") % 4 == 1, F.col("p_size") * 2).alias("strength"), F.lit("Weak").alias("strength_label"), F.when(F.col("p_partkey") % 4 == 2, 1).alias("citations"))
    return rounded(curation.comparable(rows, "report", "p_partkey").select("report", "p_partkey", "claim_type", "evidence_score", "evidence_label", "extraction"))
