"""Nulls, NaN, ties, repeated rows and empty tables in examples, counts of values, head rows, aliases, bars and heat maps."""

import pytest

from cohortlake.operators import claims, comparison, dataset, guardrails
from cohortlake.sources import tables

NAN = float("nan")


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, 200.0, "a", 5.0), (1, 300.0, "a", 5.0), (2, None, None, 5.0), (3, NAN, "b", 5.0), (4, -5.0, "b", 5.0), (5, 50.0, "c", 5.0), (6, 0.0, "", 5.0), (7, -0.0, "", None)]
    return spark.createDataFrame(rows, "id long, age double, word string, same double").repartition(3)


def test_examples(df):
    got = [(r.place, r.key, r.value) for r in guardrails.range_examples(df, "id", most=2).orderBy("place").collect()]
    assert got == [(1, 1, 200.0), (2, 1, 300.0)]
    assert guardrails.range_examples(df.limit(0), "id").count() == 0
    assert guardrails.range_examples(df.select("id", "word"), "id").count() == 0


def test_cardinality(df):
    got = {r.variable: (r.distinct, r.citation) for r in dataset.cardinality(df).collect()}
    assert {c: n for c, (n, _) in got.items()} == {"id": 7, "age": 5, "word": 4, "same": 1}
    assert got["id"][1] == "cardinality[0]: id=7"


def test_head_and_aliases(df):
    got = tables.head(df, ["id", "age"], rows=3, most=3).collect()
    assert {(r.place, r.variable): r.value for r in got} == {(p, c): v for p, row in enumerate([("1", "200.0", "a"), ("1", "300.0", "a"), ("2", None, None)]) for c, v in zip(("id", "age", "word"), row)}
    named = [(r.id, r.alias, r.seed) for r in tables.aliased(df, ["id", "age"]).collect()]
    assert sorted(a for _, a, _ in named) == [f"tool_log[{i}]" for i in range(8)] and {s for *_, s in named} == {None}
    assert [i for i, *_ in sorted(named, key=lambda r: int(r[1][9:-1]))] == [1, 1, 2, 3, 4, 5, 6, 7]
    assert tables.aliased(df.limit(0), ["id"]).count() == 0 and tables.head(df.limit(0), ["id"]).count() == 0


def test_charts(df):
    assert [(r.place, r.level, r.n) for r in guardrails.bar(df, "word", most=3).collect()] == [(1, "", 2), (2, "a", 2), (3, "b", 2)]
    assert guardrails.bar(df.limit(0), "word").count() == 0
    r = {(x.a, x.b): x.r for x in guardrails.heat_map(df, ["id", "age", "same"]).collect()}
    assert len(r) == 9 and r["id", "id"] == 1 and r["same", "same"] is None and r["id", "same"] is None and r["id", "age"] == r["age", "id"]


def test_upgrades(spark):
    m = spark.createDataFrame([("x", 3, 2), ("x", 2, 2), ("x", None, 1), ("y", 1, 2)], "report string, l int, r int")
    assert {r.report: (r.pairs, r.upgrades, r.upgrade_rate) for r in comparison.upgrades(m, "l", "r").collect()} == {"x": (3, 1, 0.3333), "y": (1, 0, 0.0)}
    assert comparison.upgrades(m.limit(0), "l", "r").count() == 0


def test_sections(spark):
    long = "A sentence of some length was written here. " * 5
    reports = [(1, "Before it all\n\nSUMMARY:\n1. First thing\nresults\n" + long + "\nResults were fine"), (2, None), (3, ""), (4, "Overview"), (5, "No heading")]
    got = claims.sectioned_claims(spark.createDataFrame(reports, "id long, text string").repartition(2), "id", "text").orderBy("id", "line", "part").collect()
    assert [(r.id, r.claim, r.section) for r in got] == [
        (1, "Before it all", None), (1, "First thing", "summary"), *[(1, "A sentence of some length was written here.", "results")] * 5, (1, "Results were fine", "results"), (5, "No heading", None),
    ]
