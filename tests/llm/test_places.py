"""Documents put together from the same few sentences: most pairs share something, few are near copies."""

import random

from pyspark.sql import functions as F

from cohortlake.llm import jaccard
from cohortlake.llm.work import Scratch


def corpus(n, rng, near=0):
    sentences = [" ".join(f"s{k}w{j}" for j in range(10)) for k in range(120)]
    texts = [" ".join(rng.sample(sentences, 60)) for _ in range(n)]
    for i in range(near):  # near copies, one edit after the other, so that chains arise
        words = texts[-1 if i % 3 else i].split()
        words[rng.randrange(len(words))] = f"edit{i}"
        texts.append(" ".join(words))
    return texts


def components_by_force(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return [top(k) for k in range(len(texts))]


class Counting(Scratch):
    rows = 0

    def save(self, df):
        out = super().save(df)
        if "block" in df.columns:
            self.rows += out.count()
        return out


def test_places_equal_brute_force(spark, monkeypatch):
    texts = corpus(120, random.Random(1), near=60)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = components_by_force(texts)
    assert [r.component_id for r in jaccard.linked(table).orderBy("doc_id").collect()] == want
    # without cells everything is found at places, and with few members these are cut into blocks
    monkeypatch.setattr(jaccard, "in_cells", lambda kept, entries, scratch, members: scratch.save(kept.selectExpr("node a", "node b").limit(0)))
    for few, members in ((32, 4), (1, 2), (10**6, 256)):
        across = jaccard.across
        with monkeypatch.context() as m:
            m.setattr(jaccard, "across", lambda *a, few=few, members=members: across(*a[:4], members, few))
            assert [r.component_id for r in jaccard.linked(table).orderBy("doc_id").collect()] == want


def test_rows_grow_with_the_documents(spark):
    rows = []
    for n in (800, 1600):
        table = spark.createDataFrame(list(enumerate(corpus(n, random.Random(2)))), "doc_id long, text string").repartition(4)
        scratch = Counting(spark)
        jaccard.grouped(table, F.col("doc_id"), scratch)
        rows.append(scratch.rows)
    assert 0 < rows[1] <= 2.4 * rows[0], rows  # a class has 19 places, then 22: more of its elements are shared
