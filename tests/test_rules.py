"""Rules and curation beyond the queries: which rules hold, order, ties, nulls, nested text."""

from pyspark.sql import functions as F

from cohortlake.operators import curation, rules


def test_first_rule_decides_and_all_are_kept(spark):
    df = spark.createDataFrame([(1,), (6,), (12,), (None,)], "x int")
    out = rules.decided(df, [("even", F.col("x") % 2 == 0, "e"), ("three", F.col("x") % 3 == 0, "t"), ("big", F.col("x") > 10, F.concat(F.lit("b"), F.col("x").cast("string")))], "kind", "none").collect()
    assert [(r.x, r.kind, r.kind_rules, r.kind_mask) for r in out] == [(1, "none", [], 0), (6, "e", ["even", "three"], 3), (12, "e", ["even", "three", "big"], 7), (None, "none", [], 0)]


def test_texts_at_the_edges(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "word " * 50_000 + "was associated with mortality."), (5, "Creatinine was (significantly [associated with mortality in the trial."), (6, "**Lactate was not associated with mortality at entry.**"), (7, "3) Lactate predicted death in the treated group."), (8, "bilirubin was higher in survivors than in others.")]
    got = {r.i: r for r in rules.gated(spark.createDataFrame(rows, "i int, t string"), "t").collect()}
    assert all(got[i].header and got[i].fragment and not got[i].eligible for i in (1, 2, 3))
    assert not got[4].eligible and not got[4].fragment and got[5].fragment and got[6].eligible and got[7].eligible and got[8].eligible and not got[8].fragment
    c = {r.i: r.category for r in rules.categorised(spark.createDataFrame([(i, t, "lactate", "Lactate") for i, t in rows], "i int, t string, v string, e string"), "t", "v", "e").collect()}
    assert c[6] == "artifact_excluded" and c[8] == "artifact_excluded" and c[1] == "artifact_excluded"


def test_equal_texts_are_read_once_and_many_texts_by_all_tasks(spark, monkeypatch):
    texts = ["Lactate was associated with mortality at entry.", "## Results", "and more", "", None, "Lactate: chi2 = 4.1, p = 0.04"]
    df = spark.createDataFrame([(i, texts[i % 6]) for i in range(600)], "i int, t string").coalesce(1)
    once = rules.gated(df, "t")
    assert "RLIKE" not in once._jdf.queryExecution().executedPlan().toString()  # the rows meet what was read of their texts
    monkeypatch.setattr(rules, "MOST_BYTES", 0)
    each = rules.gated(df, "t")
    assert sorted((tuple(r) for r in each.collect()), key=repr) == sorted((tuple(r) for r in once.collect()), key=repr) and once.columns == each.columns
    assert each.select(F.spark_partition_id()).distinct().count() > 1


def test_every_finding_has_one_fate(spark):
    rows = [(1, "Lactate was associated with mortality at entry.", "analytical"), (2, "## Results", "analytical"), (3, "Lactate: chi2 = 4.1, p = 0.04", "negative_association"), (4, "and more", "survival_result"), (5, "Values were imputed twice here.", "preprocessing"), (6, None, "artifact_excluded"), (7, "Some words without any relation.", "analytical")]
    kept, notes, gone = rules.sanitised(spark.createDataFrame(rows, "i int, t string, category string"), "t")
    assert [r.i for r in kept.collect()] == [1]
    assert sorted((r.i, r.category, r.status) for r in notes.collect()) == [(2, "statistical_note", "QC Observation"), (3, "statistical_note", "QC Observation"), (5, "preprocessing", "Preprocessing Observation")]
    assert sorted((r.i, r.reason) for r in gone.collect()) == [(4, "fragment"), (6, "fragment"), (7, "states no relation of a variable")]


def test_curation_is_the_same_from_any_partitioning(spark):
    rows = [("a", i, f"Outlier number {i % 50} in the table.") for i in range(200)] + [("a", 300, "Missing values: 3."), ("a", 301, "missing   VALUES: 3."), ("a", 302, "Next step: look again"), (None, 1, "Heaping at 5.")]
    df = spark.createDataFrame(rows, "report string, i int, t string")
    results = []
    for n in (1, 7):
        kept, gone = curation.curated(df.repartition(n), "report", "i", "t")
        results.append((sorted((tuple(r) for r in kept.collect()), key=repr), sorted((tuple(r) for r in gone.collect()), key=repr)))
    assert results[0] == results[1]
    kept, gone = results[0]
    assert [k[1] for k in sorted((k for k in kept if k[0]), key=lambda k: k[5])] == [300, *range(11)] and len(kept) + len(gone) == len(rows)
    assert {g[5] for g in gone} == {"beyond the cap", "said before", "narration"} and (301, "said before") in {(g[1], g[5]) for g in gone}


def test_cautious_words(spark):
    rows = [("Drug X will reduce mortality.", "A registry study"), ("Let me compile this.\nA plain line.\n\n", None), ("We recommend a larger trial.", "retrospective"), ("We recommend a trial (hypothesis-generating).", "cohort"), (None, "cohort")]
    df = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in df.select(curation.cautious(F.col("t"), F.col("c"))).collect()] == ["Drug X could reduce mortality (hypothesis-generating).", "A plain line.", "We recommend a larger trial (hypothesis-generating).", "We recommend a trial (hypothesis-generating).", ""]


def test_strings_at_any_depth(spark):
    df = spark.sql("SELECT 1 AS k, named_struct('a', array(named_struct('b', map('x', array('deep', NULL)))), 'n', 4) AS s, 'top' AS t, array(1, 2) AS numbers UNION ALL SELECT 2, NULL, NULL, NULL")
    assert sorted((r.k, r.path, r.text) for r in curation.strings(df, "k").collect()) == [(1, "s.a[0].b{x}[0]", "deep"), (1, "t", "top")]
    assert curation.strings(df.select("k", "numbers"), "k").count() == 0


def test_numbers_in_sentences(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.00012,), (0.05,), (-2.5,), (0.9999,)], "x double")
    assert [r[0] for r in df.select(curation.number(F.col("x"))).collect()] == ["0", "1", "1.20e-04", "0.05", "-2.5", "0.9999"]
    assert [r[0] for r in df.select(curation.p_text(F.col("x"))).collect()][:3] == ["p < 1e-12", "p > 0.99", "p=1.20e-04"]
