"""Queries of text evidence over the standard tables, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import retrieval
from cohortlake.plans.queries import MASKED, SQL, masked, query, rounded, table
from cohortlake.sources import documents, tables

_WORDS = r"""list_transform(regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[a-z0-9]+(?:[''-][a-z0-9]+)*'), w -> CASE WHEN length(w) <= 4 THEN w WHEN suffix(w, 'ies') AND length(w) > 5 THEN w[:-4] || 'y' WHEN suffix(w, 'ing') AND length(w) > 5 THEN w[:-4] WHEN suffix(w, 'ed') THEN w[:-3] WHEN suffix(w, 'es') THEN w[:-3] WHEN suffix(w, 's') THEN w[:-2] ELSE w END)"""
_WORDS = _WORDS.replace("w ->", "lambda w:")
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP)
_TOKENS = f"list_filter({_WORDS}, lambda w: length(w) >= 2 AND w NOT IN ({_STOP}))"


@query("document_tokens", f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS different, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def document_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", retrieval.tokens(F.col("text")).alias("t"))
    return rounded(t.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("different"), F.md5(F.array_join("t", " ")).alias("digest")))


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'tool_result' WHEN 1 THEN 'data_dictionary' WHEN 2 THEN 'user_input' WHEN 3 THEN 'literature' ELSE 'file' END"
_SHORT = "UNION ALL ".join(f"SELECT '{k}' AS s, unnest([{', '.join(map(repr, v))}]) AS term " for k, v in retrieval.SHORT.items())


@query(
    "boosted_search",
    f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w, CASE doc_id % 5 WHEN 0 THEN 1.2 WHEN 1 THEN 1.15 WHEN 2 THEN 1.1 ELSE 1.0 END AS f FROM documents), z AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d),
    p AS (SELECT doc_id, l, f, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, f, unnest(w) AS term FROM d) GROUP BY ALL), x(s, term) AS ({_SHORT}),
    q AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark UNION SELECT item_id, x.term FROM (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark) JOIN x ON w = s),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))) * any_value(p.f), 6) AS score FROM p JOIN q USING (term) JOIN f USING (term), z GROUP BY 1, 2)
    SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 1) WHERE rank <= 5""",
)
def boosted_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("kind", F.expr(_KIND))
    return rounded(retrieval.boosted_search(docs, "doc_id", "text", "kind", table(spark, sf_dir, "benchmark"), "item_id", "text", least=1.0))


@query("sentence_chunks")
def sentence_chunks(spark, sf_dir):
    return retrieval.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("reranked_search")
def reranked_search(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = retrieval.boosted_search(docs.withColumn("kind", F.lit("file")), "doc_id", "text", "kind", asked, "item_id", "text", top=20)
    return rounded(retrieval.rerank(retrieval.worded(hits, docs, "doc_id", "text", asked, "item_id", "text"), "item_id", "doc_id"))


@query("corpus_statistics", f"SELECT {_KIND} AS source, count(*) AS documents, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters, CAST(coalesce(sum(length(text) // 4), 0) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def corpus_statistics(spark, sf_dir):
    return rounded(retrieval.corpus_statistics(table(spark, sf_dir, "documents").withColumn("kind", F.expr(_KIND)), "text", "kind"))


_ARTICLE = "concat(o_orderpriority, ' trial of ', CAST(1960 + o_custkey % 65 AS {s}), ': n = ', CAST(1 + o_custkey % 9 AS {s}), ',', CAST(100 + o_custkey % 900 AS {s}), ', then n=', CAST(o_custkey % 5000 AS {s}), '. HR = ', CAST(o_custkey % 3 AS {s}), '.', CAST(10 + o_custkey % 90 AS {s}), ' (95% CI: 0.', CAST(o_custkey % 9 AS {s}), ' - 1.', CAST(o_custkey % 7 AS {s}), '), p < 0.0', CAST(1 + o_custkey % 9 AS {s}), CASE WHEN o_custkey % 2 = 0 THEN ' and OR: 1.5 for death or event-free survival' ELSE ' with p = 0.25 in response' END)"


@query(
    "evidence_table",
    rf"""SELECT o_orderkey, try_cast(nullif(regexp_extract(t, '(?i)\bHR[:\s=]*([0-9]+\.[0-9]+)', 1), '') AS DOUBLE) AS hazard_ratio, try_cast(nullif(regexp_extract(t, '(?i)\bOR[:\s=]*([0-9]+\.[0-9]+)', 1), '') AS DOUBLE) AS odds_ratio, try_cast(nullif(regexp_extract(t, '(?i)\bRR[:\s=]*([0-9]+\.[0-9]+)', 1), '') AS DOUBLE) AS risk_ratio,
    CAST('0.' || CAST(o_custkey % 9 AS VARCHAR) AS DOUBLE) AS ci_low, CAST('1.' || CAST(o_custkey % 7 AS VARCHAR) AS DOUBLE) AS ci_high, '0.0' || CAST(1 + o_custkey % 9 AS VARCHAR) || CASE WHEN o_custkey % 2 = 1 THEN ',0.25' ELSE '' END AS p_values,
    greatest((1 + o_custkey % 9) * 1000 + 100 + o_custkey % 900, o_custkey % 5000) AS sample_size, CASE WHEN o_custkey % 2 = 0 THEN 'survival,death,event-free' ELSE 'response' END AS outcomes, 1960 + o_custkey % 65 AS year
    FROM (SELECT *, {_ARTICLE.format(s="VARCHAR")} AS t FROM orders)""",
)
def evidence_table(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ARTICLE.format(s="STRING")).alias("t"))
    return rounded(retrieval.evidence_table(rows, "o_orderkey", "t"))


_TOPIC = """list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'that', 'this', 'were', 'was', 'are', 'have', 'has', 'had', 'into',
    'than', 'then', 'over', 'under', 'between', 'during', 'after', 'before', 'their', 'there', 'these', 'those', 'patients', 'patient', 'study', 'analysis', 'trial', 'finding', 'findings', 'significant', 'statistically', 'associated',
    'risk', 'outcome', 'mortality', 'survival')))"""


@query("topical_support", f"WITH f AS (SELECT s_suppkey AS f, unnest({_TOPIC.format(t='s_name')}) AS w FROM (SELECT s_suppkey, 'the ' || CASE s_suppkey % 4 WHEN 0 THEN 'brushed brass part' WHEN 1 THEN 'large steel' WHEN 2 THEN 'mortality and survival risk of tin' ELSE 'promo tin plated' END AS s_name FROM supplier)), a AS (SELECT p_partkey AS a, unnest({_TOPIC.format(t=chr(39) + chr(39) + ' || p_type')}) AS w FROM part), h AS (SELECT f, count(*) AS n FROM (SELECT f, a FROM f JOIN a USING (w) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1) SELECT s_suppkey, CASE WHEN n > 0 THEN 'Supported' ELSE 'Novel' END AS status, coalesce(n, 0) AS articles FROM supplier LEFT JOIN h ON f = s_suppkey")
def topical_support(spark, sf_dir):
    said = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('the ', CASE s_suppkey % 4 WHEN 0 THEN 'brushed brass part' WHEN 1 THEN 'large steel' WHEN 2 THEN 'mortality and survival risk of tin' ELSE 'promo tin plated' END) AS t")
    return rounded(retrieval.topical_support(said, "s_suppkey", "t", table(spark, sf_dir, "part"), "p_partkey", "p_type"))


@query("citation_registry", "WITH r AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 3 = 0) SELECT s_suppkey, s_nationkey, s_nationkey IN (SELECT c_nationkey FROM r WHERE c_nationkey % 2 = 0) AS citable FROM supplier")
def citation_registry(spark, sf_dir):
    known = retrieval.registry(table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0 AND c_nationkey % 2 = 0"), "c_nationkey", "c_custkey")
    return rounded(retrieval.citable(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", known, "c_nationkey"))


@query("finding_lookups", "WITH o AS (SELECT p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, lower(trim(p_type)) ORDER BY p_partkey) AS o FROM part WHERE p_size > 5) SELECT p_brand, p_partkey, alias, substring(trim(p_type), 1, 300) AS snippet FROM (SELECT *, 'lit[' || CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS VARCHAR) || ']' AS alias, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM o WHERE o = 1) WHERE r <= 10")
def finding_lookups(spark, sf_dir):
    rows = retrieval.lookups(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type", F.col("p_size") > 5)
    return rounded(retrieval.snippets(rows, "p_brand", ["p_partkey"], "p_type").select("p_brand", "p_partkey", "alias", "snippet"))


_RESULT = "CASE event_id % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN concat('{{\"p_value\": ', CAST(round(value, 2) AS {s}), ', \"n\": ', CAST(user_id AS {s}), ', \"note\": \"', repeat('a long result ', CAST(event_id % 30 AS INT)), '\"}}') WHEN 2 THEN concat('{{\"error\": \"', event_type, ' failed and nothing else is known about why it did so today\"}}') ELSE concat('plain words on ', event_type, repeat(' and more', CAST(event_id % 20 AS INT))) END"


@query(
    "tool_results",
    f"""WITH t AS (SELECT event_id, event_type, trim({_RESULT.format(s="VARCHAR")}) AS t FROM events)
    SELECT event_id, CASE WHEN lower(t) IN ('', '{{}}', '[]', 'null', 'none') THEN 0.0 WHEN contains(lower(t), '"error"') AND length(t) < 250 THEN 0.05 ELSE round(CAST(0.2 AS DOUBLE) + CASE WHEN length(t) >= 80 THEN 0.25 ELSE 0 END + CASE WHEN length(t) >= 250 THEN 0.15 ELSE 0 END + CASE WHEN contains(t, 'p_value') THEN 0.25 ELSE 0 END + CASE WHEN starts_with(t, '{{') AND suffix(t, '}}') THEN 0.15 ELSE 0 END, 3) END AS quality,
    CASE WHEN starts_with(t, '{{"p') THEN 'n,note,p_value' WHEN starts_with(t, '{{"e') THEN 'error' ELSE '' END AS keys, length(t) AS n FROM t WHERE length(t) >= 60 AND NOT (contains(lower(t), '"error"') AND length(t) < 300)""",
)
def tool_results(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(_RESULT.format(s="STRING")).alias("t"))
    out = documents.tool_results(rows, "event_id", "event_type", "t")
    return rounded(out.select(F.col("id").cast("long").alias("event_id"), F.col("metadata")["quality"].cast("double").alias("quality"), F.col("metadata")["keys"].alias("keys"), F.length("content").alias("n")))


@query("dictionary_lines", "SELECT CAST(event_id AS VARCHAR) AS id, 'Event' || chr(10) || 'k: ' || json_extract_string(props, '$.k') || chr(10) || 'more.a: ' || event_type || chr(10) || 'more.b: 2' AS content FROM events")
def dictionary_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("j", F.concat(F.lit('{"more": {"b": 2, "a": "'), "event_type", F.lit('"}, '), F.expr("substring(props, 2)")))
    return documents.dictionary_lines(rows, "event_id", "j", "Event").select("id", "content")


@query("literature_documents", "SELECT CAST(p_partkey AS VARCHAR) AS id, 'Title: ' || p_name || chr(10) || 'Authors: ' || array_to_string(string_split(p_type, ' ')[1:5], ', ') || CASE WHEN p_size % 3 > 0 THEN chr(10) || 'Year: ' || CAST(1990 + p_size AS VARCHAR) ELSE '' END || chr(10) || 'Abstract: ' || p_brand || ' study' AS content FROM part")
def literature_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "split(p_type, ' ') AS authors", "CASE WHEN p_size % 3 > 0 THEN 1990 + p_size END AS year", "concat(p_brand, ' study') AS abstract")
    return documents.literature(rows, "p_partkey", "p_name", "authors", "year", "abstract").select("id", "content")


_PREVIEW = "SELECT '{c}' AS variable, '{k}' AS kind, round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing, {n} FROM {t}"
_NUMBERS = "count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max"
_NONE = "NULL AS n, NULL AS mean, NULL AS sd, NULL AS min, NULL AS p25, NULL AS median, NULL AS p75, NULL AS max"


@query("table_preview", " UNION ALL ".join(_PREVIEW.format(c=c, k=k, t=MASKED, n=(_NONE if k == "string" else _NUMBERS).format(c=c)) for c, k in (("l_orderkey", "bigint"), ("l_returnflag", "string"), ("a", "double"), ("b", "double"), ("c", "double"))))
def table_preview(spark, sf_dir):
    return rounded(tables.preview(masked(spark, sf_dir)), 4)


@query(
    "evidence_summary",
    "SELECT count(*) AS papers, count(hazard_ratio) AS with_hazard_ratio, count(odds_ratio) AS with_odds_ratio, count(ci_low) AS with_interval, count(*) FILTER (p_values <> '') AS with_p, count(sample_size) AS with_sample, max(sample_size) AS largest_sample FROM (" + SQL["evidence_table"] + ")",
)
def evidence_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ARTICLE.format(s="STRING")).alias("t"))
    return rounded(retrieval.evidence_summary(retrieval.evidence_table(rows, "o_orderkey", "t")))


@query(
    "literature_queries",
    """
WITH h AS (SELECT s_nationkey AS report, s_suppkey, 'The albumin level (top[1]) is associated with ' || CASE s_suppkey % 3 WHEN 0 THEN 'survival' WHEN 1 THEN 'bleeding' ELSE 'cholangitis' END || ' in region ' || lower(n_name) || ', as we can see.' AS t, s_suppkey % 3 AS k, lower(n_name) AS n
    FROM supplier JOIN nation ON s_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY s_suppkey) AS i FROM h),
q AS (SELECT report, s_suppkey, 'albumin level ' || CASE k WHEN 0 THEN 'survival' WHEN 1 THEN 'bleeding' ELSE 'cholangitis' END || ' region ' || n || ' see' || CASE WHEN k = 2 THEN '' ELSE ' biliary liver' END || CASE WHEN k = 0 THEN ' clinical trial' ELSE '' END AS query FROM r WHERE i <= 4)
SELECT report, min(s_suppkey) AS s_suppkey, query FROM q GROUP BY report, query""",
)
def literature_queries(spark, sf_dir):
    said = F.concat(F.lit("The albumin level (top[1]) is associated with "), F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'survival' WHEN 1 THEN 'bleeding' ELSE 'cholangitis' END"), F.lit(" in region "), F.lower("n_name"), F.lit(", as we can see."))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("report"), "s_suppkey", said.alias("t"))
    return rounded(retrieval.search_text(rows, "report", "s_suppkey", "t", ["serum_bilirubin"]))
