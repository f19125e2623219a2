"""Null ids, clashing names, very long texts, repeated ids, vectors of several lengths, odd letters; and the vector operators at
a size at which their methods, not their smallest cases, do the work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from cohortlake.llm import bpe, jaccard, language, licences, mixing, neardup, neighbours, pii, quality, sharding
from cohortlake.llm.vectors import unit

CLASH = "doc_id long, text string, _row string, lang string, source string, n_chars long, key string, size long, tag string, cut int, epoch int, copies int, epochs int, source_size int, target int, stat_words double, node long, c0 int, bucket int"
LONG = "alpha beta gamma delta " * 50_000  # over 1 MB
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(None, "one two three four five six"), (None, None), (1, LONG), (2, ""), (3, " \t"), (1, "same id, other text that is here"), (4, "²³ ½"), (5, "Ⅷ"), (6, "x"), (6, "x")]
    rest = ("k", 1, "t", 2, 3, 4, 5, 6, 7, 0.5, 9, 10, 11)
    return spark.createDataFrame([(i, t, "r", "en" if t else None, None if i == 2 else "s", 3, *rest) for i, t in texts], CLASH)


def test_odd_documents(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    assert language.identify(odd, PIECES).count() == n
    und = {r.text for r in language.identify(odd, PIECES).withColumn("k", F.monotonically_increasing_id()).join(odd.withColumn("k", F.monotonically_increasing_id()).select("k", "text"), "k").filter("lang_pred = 'und'").collect()}
    assert und == {None, "", " \t", "²³ ½", "Ⅷ"}
    assert pii.detect(odd).count() == n and licences.scan(odd).count() == n and quality.score(odd, labels).count() == n
    shards = sharding.shard(odd).collect()
    assert len(shards) == n and max(r["size"] for r in shards) == len(LONG) + 8
    linked = jaccard.linked(odd).collect()
    assert sorted(r.n_shingles for r in linked) == sorted([2, 0, 4, 0, 0, 3, 1, 1, 1, 1])
    coded = bpe.encode_decode(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert {r.decoded.decode() for r in coded.collect()} == {r.text or "" for r in odd.collect()}
    for out in (quality.good_documents(odd, labels), jaccard.one_of_each(odd), pii.redacted(odd), mixing.mixed_documents(odd)):
        assert out.columns == odd.columns and out.dtypes == odd.dtypes and out.count() >= 0
    assert jaccard.one_of_each(odd).count() == n - 1  # the repeated row
    taken = sum(r.taken for r in mixing.mix(odd).collect())
    texts = sum(len((r.text or "").split()) for r in mixing.mixed_documents(odd).collect())
    assert taken == texts


def test_spans_beyond_the_base_patterns(spark):
    r = __import__("random").Random(4)
    first, last, word = ["ann", "bob", "eva", "tim"], ["lee", "kim", "ray"], ["river", "bread", "house", "green"]
    rows, wanted, decoys = [], set(), set()

    def add(before, span, after, kind, take):
        i, text = len(rows), f"{' '.join(r.choices(word, k=r.randint(3, 9)))} {before}"
        if take is not None:
            (wanted if take else decoys).add((i, f"{kind}:{len(text)}:{len(text) + len(span)}"))
        rows.append((i, text + span + after))

    for k in range(120):
        d = lambda n: "".join(r.choices("0123456789", k=n))
        add("please mail ", f"{r.choice(first)}.{r.choice(last)}@mail{k}.com", " soon", "email", None)
        add("please mail ", f"{r.choice(first)} (at) site{k} (dot) org", " soon", "email", True)
        add("we will meet ", f"{r.choice(word)} at place{k}.example", " soon", "email", False)
        add("call my phone ", f"+1 ({r.randint(200, 999)}) 555-{d(4)}", " today", "phone", None)
        add("call my phone ", f"({r.randint(200, 999)}) 555-{d(4)}", " today", "phone", True)
        add("the host address ", f"10.{r.randint(1, 250)}.3.{r.randint(1, 250)}", " is up", "ip", None)
        add("the host address ", f"fe80:{r.randint(10, 99)}:ab:cd:{r.randint(10, 99)}:9", " is up", "ip", True)
    got = {x.doc_id: set(x.spans.split(",")) for x in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(s in got[i] for i, s in wanted), [(rows[i], s, got[i]) for i, s in wanted if s not in got[i]][:3]
    assert not any(s in got[i] for i, s in decoys), [(rows[i], s) for i, s in decoys if s in got[i]][:3]


def planted(spark, n=6000, dim=16):
    """Gaussian vectors; chains of near copies; copies; one id with two vectors; odd ones."""
    r = np.random.default_rng(5)
    x = r.normal(size=(n, dim)).astype(np.float32)
    for k in range(0, 600, 3):
        x[k + 1] = x[k] + 0.12 * x[k + 1]
        x[k + 2] = x[k + 1] + 0.3 * x[k + 2]
    x[700:760] = x[700] + 0.05 * x[700:760]  # a crowd
    x[800:820] = x[800]  # copies
    ids = np.arange(n)
    ids[900] = 901  # one id, two vectors
    table = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    table += [(n, [1.0] * (dim - 4)), (n + 1, [1.0] * (dim - 4) + [0.0, 0.1, 0.0, 0.0]), (None, x[3].tolist()), (n + 2, None)]
    full = np.vstack([x, [[1.0] * (dim - 4) + [0.0] * 4], [[1.0] * (dim - 4) + [0.0, 0.1, 0, 0]]])
    return spark.createDataFrame(table, "vec_id long, embedding array<float>"), np.append(ids, [n, n + 1]), unit(full.astype(np.float32))


@pytest.mark.parametrize("dense", [8, 0])
def test_near_duplicates_at_size(spark, dense):
    table, ids, u = planted(spark)
    got = neardup.near_duplicates(table, cell=256, recall=0.9999, block=512, dense=dense).collect()
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert links.sum() > 4000
    root = np.arange(len(u))
    while True:
        new = np.array([min(root[i], root[links[i]].min(initial=len(u))) for i in range(len(u))])
        if (new == root).all():
            break
        root = new
    least = {k: ids[root == k].min() for k in {*root.tolist()}}
    want = sorted((int(i), int(links[k].sum()), int(least[root[k]])) for k, i in enumerate(ids))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id <= 6001) == want
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id > 6001} == {(None, 0, None, True), (6002, 0, 6002, True)}


def test_codes_estimate_without_bias():
    r = np.random.default_rng(0)
    a = unit(r.normal(size=(400, 128)))
    b = unit(a + 0.4 * r.normal(size=a.shape) / np.sqrt(128) * 3)
    c, d = neardup.codes(a), neardup.codes(b)
    pack = lambda c: np.hstack([np.stack([c["factor"], c["low"], c["step"]], 1).astype("<f4").view(np.uint8).reshape(400, -1), c["signs"], c["steps"]])
    exact = (a * b).sum(1)
    assert abs((np.diag(neardup.estimates(pack(c), pack(d), 128, 0.0)) - exact).mean()) < 0.01
    assert (np.diag(neardup.estimates(pack(c), pack(d), 128, 5.0)) >= exact).all()


@pytest.mark.parametrize("tables", [4, 0])  # 0: from a random graph
def test_neighbours_at_size(spark, tables):
    table, ids, u = planted(spark)
    asked = F.col("vec_id") % 50 == 0
    got = {}
    for r in neighbours.search(table, asked, tables=tables).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = sorted((-float(u[q] @ u[k]), int(i)) for k, i in enumerate(ids) if i != ids[q])[:5]
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and len({v for _, v, _ in own}) == 5 and ids[q] not in {v for _, v, _ in own}
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(own, own[1:]))
        hits += sum(s >= -near[4][0] - 1e-9 for _, _, s in own)
        total += 5
    assert hits >= 0.95 * total


def test_neighbours_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0]), (3, [1.0, 0.1]), (100, None)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in neighbours.search(table, F.col("vec_id") % 50 == 0).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 3), (0, 2, 50)] and {g[2] for g in got if g[0] == 50} == {0, 3}


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = stage(spark, docs, data).cache()
    first, good, single, clean, mixed = seen
    assert all(d.columns == first.columns for d in seen)
    scores = {r.doc_id: r.predicted for r in quality.score(first, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    linked = jaccard.linked(good).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in linked}
    assert clean.count() == single.count() and pii.detect(clean).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    taken = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix(clean).collect() if r["size"]}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in counts.items() if i in taken}
    text = {r.doc_id: r.text for r in mixed.collect()}
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in docs.collect()) and docs.count() == mixed.count()
    whole = corpus_pipeline.run(spark, data).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, docs.collect()))
