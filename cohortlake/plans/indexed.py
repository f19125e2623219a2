"""A stored index after additions, replacements and removals, and the SQL of an index built anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlake.operators import longform
from cohortlake.operators.index import Index
from cohortlake.plans.queries import query, rounded, table

_DOCS = "(SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN lower(text) || ' renewed words' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 2)"


def changed_index(spark, sf_dir) -> Index:
    """Even documents first, then odd ones, then a fifth again with other texts, and a seventh removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = Index(spark, f"{longform.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.put(docs.filter("doc_id % 2 = 0"), "doc_id", "text")
    index.put(docs.filter("doc_id % 2 = 1"), "doc_id", "text")
    index.put(docs.filter("doc_id % 5 = 1").select("doc_id", F.concat(F.lower("text"), F.lit(" renewed words")).alias("text")), "doc_id", "text")
    index.remove(docs.filter("doc_id % 7 = 2"), "doc_id")
    return index


@query(
    "index_search",
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS w FROM {_DOCS}), z AS (SELECT count(*) AS n, avg(len(w)) AS av FROM d),
p AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term FROM benchmark UNION SELECT -1, unnest(['renewed', 'words'])), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / av))), 6) AS score FROM p JOIN q USING (term) JOIN f USING (term), z GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, doc_id AS d, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def index_search(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.lit("renewed words").alias("text")))
    return rounded(changed_index(spark, sf_dir).search(asked, "item_id", "text"))


@query(
    "index_statistics",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS w FROM {_DOCS}), p AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM d)
SELECT (SELECT count(*) FROM d) AS documents, (SELECT CAST(sum(len(w)) AS BIGINT) FROM d) AS tokens, (SELECT count(DISTINCT term) FROM p) AS terms, (SELECT count(*) FROM p) AS postings, 1 AS generations""",
)
def index_statistics(spark, sf_dir):
    index = changed_index(spark, sf_dir)
    index.merge()
    return rounded(index.statistics())
