"""BM25 of ``bm25`` against its SQL where keys and queries repeat, texts are null, empty or copies, and by each of its ways."""

import random

import duckdb
import pytest

from cohortlake.operators import evidence, retrieval
from cohortlake.plans import texts  # noqa: F401 - adds its queries
from cohortlake.plans.queries import QUERIES, SQL

WORDS = "ox hen cat dog owl elk ant bee fly cow pig rat bat eel cod yak emu ape asp jay".split()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Folders of documents and queries: keys that are one row's, and keys that some rows share."""
    draw, out = random.Random(7), {}
    said = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    rows = [(i, said(draw.randint(1, 30))) for i in range(300)] + [(i, "ox hen ox") for i in range(300, 340)] + [(340, None), (341, None), (342, ""), (343, "--"), (344, None)]
    asked = [(i, said(draw.randint(1, 6))) for i in range(9)] + [(9, ""), (10, "unheard"), (11, None), (3, "ox cat unheard"), (3, "cat emu")]
    for name, docs in (("once", rows), ("shared", rows + [(5, "ox owl"), (6, said(4)), (6, said(4)), (7, rows[7][1])])):
        at = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out[name] = at
    return out


def by_sql(query: str, at: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    return sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({SQL[query]})").fetchall())


@pytest.mark.parametrize("query", ["bm25_search", "boosted_search"])
@pytest.mark.parametrize("way", ["blocks", "one row a block", "joined"])
@pytest.mark.parametrize("keys", ["once", "shared"])
def test_search_is_its_sql(spark, made, monkeypatch, keys, way, query):
    if way == "one row a block":
        monkeypatch.setattr(evidence, "CELLS", 1)
    if way == "joined":
        monkeypatch.setattr(evidence, "MOST_TERMS", 0)
    got = sorted(tuple(r) for r in QUERIES[query](spark, made[keys]).select("item_id", "rank", "doc_id", "score").collect())
    wanted = by_sql(query, made[keys])
    assert len(wanted) > 20 and [r[:3] for r in got] == [r[:3] for r in wanted] and [r[3] for r in got] == pytest.approx([r[3] for r in wanted], abs=2e-6)


def test_only_the_best_are_dealt_out(spark, made):
    plan = QUERIES["bm25_search"](spark, made["once"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BroadcastExchange" not in plan


def test_only_texts_that_were_hit_are_taken_apart(spark):
    docs = spark.createDataFrame([(1, "Ox and hens"), (2, "cats"), (3, None)], "k long, t string")
    asked = spark.createDataFrame([(7, "HR of hens"), (8, "cats")], "q long, t string")
    hits = spark.createDataFrame([(7, 1, 2.0), (8, 1, 1.5), (7, 3, 1.0)], "q long, k long, score double")
    out = retrieval.worded(hits, docs, "k", "t", asked, "q", "t")
    assert sorted(tuple(r) for r in out.select("q", "k", "words", "asked").collect()) == [(7, 1, ["ox", "hens"], ["hr", "hens", "hazard", "ratio"]), (7, 3, None, ["hr", "hens", "hazard", "ratio"]), (8, 1, ["ox", "hens"], ["cats"])]
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()
