"""The stored index: changes in any order equal an index built anew; a generation that was not committed does not count."""

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import evidence
from cohortlake.operators.index import Index, counted


def test_changes_equal_a_new_index(spark, tmp_path):
    one = [(1, "red fox"), (2, "red red hen"), (3, None), (4, "blue owl and red owl")]
    docs = spark.createDataFrame(one, "k long, t string")
    asked = spark.createDataFrame([("a", "red owl"), ("b", "hen"), ("c", "nothing here")], "q string, t string")
    index = Index(spark, str(tmp_path / "i"), buckets=4)
    assert index.search(asked, "q", "t").count() == 0  # empty
    index.put(docs, "k", "t")

    def same(texts):
        rebuilt = evidence.bm25(spark.createDataFrame(sorted(texts.items()), "k long, t string"), "k", "t", asked, "q", "t")
        wanted = sorted(tuple(r) for r in rebuilt.collect())
        assert sorted(tuple(r) for r in index.search(asked, "q", "t").collect()) == wanted
        assert sorted(r.d for r in index.documents().collect()) == sorted(texts)
        return wanted

    texts = dict(one)
    assert same(texts)
    index.put(spark.createDataFrame([(2, "owl owl owl"), (9, "hen")], "k long, t string"), "k", "t")
    texts |= {2: "owl owl owl", 9: "hen"}
    same(texts)
    index.remove(spark.createDataFrame([(1,), (77,)], "k long"), "k")
    del texts[1]
    same(texts)
    index.put(spark.createDataFrame([(1, "red hen")], "k long, t string"), "k", "t")  # removed, then there again
    texts[1] = "red hen"
    before = same(texts)
    index.merge()
    assert same(texts) == before and index.statistics().first().generations == 1
    # a write that stops before its commit
    index._write(spark.createDataFrame([(5, 1, "owl", 1)], "d long, len int, term string, tf long"), spark.createDataFrame([(5, 1)], "d long, len int"), None, 99)
    assert same(texts) == before
    with pytest.raises(ValueError):
        index.put(spark.createDataFrame([(1, "x"), (1, "y")], "k long, t string"), "k", "t")


def test_only_own_buckets_are_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), buckets=16)
    index.put(spark.range(50).select("id", F.concat_ws(" ", F.lit("w"), F.concat(F.lit("word"), F.col("id"))).alias("t")), "id", "t")
    plan = index.postings(spark.createDataFrame([("word7",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]


def test_words_are_counted_where_they_are(spark):
    words = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["a"]), (4, ["c"] * 300 + ["d"])], "d long, w array<string>")
    out = counted(words)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, 3, None, 1), (1, 3, "a", 1), (1, 3, "b", 2), (2, 0, None, 1), (3, 1, None, 1), (3, 1, "a", 1), (4, 301, None, 1), (4, 301, "c", 300), (4, 301, "d", 1)], key=repr)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_queries_meet_postings_dealt_by_document(spark):
    index = spark.createDataFrame([(d, 3, t, 1) for d in range(50) for t in ("x", "y")], "d long, len int, term string, tf long")
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in ("x", "y")], "q int, term string")
    size = spark.createDataFrame([(50, 3.0)], "n long, avg double")
    out = evidence.search(index, size, asked, 2, 1.5, 0.75)
    assert out.count() == 80 and {r.d for r in out.collect()} == {0, 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [d" in plan and "hashpartitioning(q" in out._jdf.queryExecution().executedPlan().toString()
