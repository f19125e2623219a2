"""Examples, counts of values, head rows, numbered calls, bars, heat maps and upgrades as queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlake.operators import claims, comparison, dataset, guardrails
from cohortlake.plans.queries import query, rounded, table
from cohortlake.plans.studies import _P, patients
from cohortlake.sources import tables

_OUT = "SELECT '{c}' AS variable, row_number() OVER (ORDER BY patient, {c}) AS place, patient AS key, CAST({c} AS DOUBLE) AS value FROM {p} WHERE {c} < {lo} OR {c} > {hi} QUALIFY place <= 5"


def _outside() -> str:
    """The plausible ranges are looked up, as they are fixed values; what leaves them is found by SQL."""
    rules = [(c, r[1], r[2]) for c in ("age", "serum_bili", "albumin") if (r := guardrails.rule_for(c, guardrails.RANGES))]
    return " UNION ALL ".join(f"SELECT variable, place, key, round(value, 6) AS value FROM ({_OUT.format(c=c, lo=lo, hi=hi, p=_P)})" for c, lo, hi in rules)


@query("range_examples", _outside())
def range_examples(spark, sf_dir):
    return rounded(guardrails.range_examples(patients(spark, sf_dir), "patient"))


_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]


@query(
    "column_cardinality",
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS distinct_ FROM lineitem" for c in _LINE) + """), p AS (SELECT *, row_number() OVER (ORDER BY distinct_ DESC, variable) - 1 AS place FROM c)
    SELECT variable, distinct_ AS "distinct", place, 'cardinality[' || place || ']: ' || variable || '=' || distinct_ AS citation FROM p""",
)
def column_cardinality(spark, sf_dir):
    return dataset.cardinality(table(spark, sf_dir, "lineitem").select(*_LINE))


_HEAD = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(
    "table_head",
    "WITH h AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer QUALIFY place < 25) "
    + " UNION ALL ".join(f"SELECT place, '{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM h" for c in _HEAD),
)
def table_head(spark, sf_dir):
    return tables.head(table(spark, sf_dir, "customer").select(*_HEAD), ["c_custkey"])


@query("call_aliases", "SELECT event_id, event_type, 'tool_log[' || (row_number() OVER (ORDER BY ts, event_id) - 1) || ']' AS alias, CAST(7 AS BIGINT) AS seed FROM events")
def call_aliases(spark, sf_dir):
    calls = tables.aliased(table(spark, sf_dir, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], seed=7)
    return calls.drop("ts")


@query("bar_chart", "SELECT row_number() OVER (ORDER BY n DESC, level) AS place, level, n FROM (SELECT CAST(l_quantity AS BIGINT) :: VARCHAR AS level, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1) QUALIFY place <= 30")
def bar_chart(spark, sf_dir):
    return guardrails.bar(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("quantity")), "quantity")


_MAP = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "heat_map",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + (f"CASE WHEN var_samp({a}) > 0 THEN CAST(1 AS DOUBLE) END" if a == b else f"round(corr({a}, {b}), 6)") + " AS r FROM lineitem" for a in _MAP for b in _MAP),
)
def heat_map(spark, sf_dir):
    return rounded(guardrails.heat_map(table(spark, sf_dir, "lineitem"), _MAP))


@query(
    "evidence_upgrades",
    "SELECT o_orderpriority AS report, count(*) AS pairs, count(*) FILTER (l_quantity > o_custkey % 50) AS upgrades, round(count(*) FILTER (l_quantity > o_custkey % 50) / count(*), 4) AS upgrade_rate FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def evidence_upgrades(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    matches = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return comparison.upgrades(matches.selectExpr("o_orderpriority AS report", "l_quantity AS l_evidence", "o_custkey % 50 AS r_evidence"), "l_evidence", "r_evidence")


# a report an order: a line for each of its items, under headings in several spellings
_ITEM = "concat(CASE l_linenumber WHEN 2 THEN 'Results:\n' WHEN 4 THEN '- DISCUSSION\n' WHEN 6 THEN 'Data quality notes:\n\n' ELSE '' END, 'Part ', l_partkey, ' has status ', l_returnflag)"
_HEADS = ", ".join(f"'{h}'" for h in ("summary", "results", "discussion", "data quality notes"))


@query(
    "claim_sections",
    f"""WITH r AS (SELECT l_orderkey AS report, string_agg({_ITEM.replace(chr(10), "' || chr(10) || '")}, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) AS text FROM lineitem GROUP BY 1),
    l AS (SELECT report, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS l FROM r), c AS (SELECT report, line, CASE WHEN starts_with(l, '- ') THEN l[3:] ELSE l END AS claim FROM l WHERE l <> ''),
    h AS (SELECT *, CASE WHEN lower(rtrim(claim, ':')) IN ({_HEADS}) THEN lower(rtrim(claim, ':')) END AS head FROM c), s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY report ORDER BY line) AS section FROM h)
    SELECT report, line, 0 AS part, claim, section FROM s WHERE head IS NULL""",
)
def claim_sections(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS report", "l_linenumber", "l_partkey", f"{_ITEM} AS item".replace("\n", "\\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "item"))), lambda x: x["item"]), "\n")
    return claims.sectioned_claims(items.groupBy("report").agg(text.alias("text")), "report", "text")
