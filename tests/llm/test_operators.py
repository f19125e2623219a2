"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and
columns of clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortlake.llm import bpe, jaccard, language, mixing, neardup, neighbours, pii, quality, sharding

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, node long, bucket int"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(5)
WORDS = [["the", "house", "river", "walked", "under", "green", "often", "bread"], ["der", "haus", "fluss", "unter", "oft", "brot", "nicht", "schön"]]


def sentence(k, n):
    return " ".join(rng.choice(WORDS[k]) for _ in range(n))


def rows():
    out = [(i, sentence(i % 2, 40 + i), ("en", "de")[i % 2], f"s{i % 3}") for i in range(24)]
    base = " ".join(f"w{k}" for k in range(80))
    out += [(100 + k, base if k < 4 else base + f" more{k}", "en", "s0") for k in range(8)]
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, " \t\n", None, "s2"), (203, "x" * 70_000, "en", None), (204, "Mail a.b@c.org or +1 (555) 555-1234, 4111 1111 1111 1111 at 10.0.0.1", "en", "s1"), (205, "one two", "en", "s1")]
    out += [out[0]] * 3
    return [(*r, 1, 2, "k", 3, 4) for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_language(docs, none):
    got = {r.doc_id: r for r in language.identify(docs, PIECES).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and language.identify(none, PIECES).count() == 0
    assert {got[i].lang_pred for i in (200, 201, 202)} == {"und"}
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(24))
    assert all(0 <= r.score <= 1 for r in got.values())


def test_marginal_is_the_sum_of_segmentations():
    model = language.Unigrams(["▁", "a", "b", "ab", "▁a", "ba"], ["x"])
    model.p[:-1, 0] = np.linspace(0.1, 0.3, 6)
    p = {h: model.p[k, 0] for k, h in enumerate(model.hashes)}
    one = lambda s: p.get(np.uint64(model._hash(s)), 0)

    def total(s):
        return sum(one(s[:k]) * total(s[k:]) for k in range(1, len(s) + 1)) if s else 1

    order, logs = model.marginals(["abba", "ab", "baab"])
    for word, log in zip(order, logs[:, 0]):
        assert np.exp(log) == pytest.approx(total("▁" + word))


def brute_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii(spark, docs, none):
    made = "".join
    extra = [(1000 + k, made(rng.choice("a@@..1 2+-0()9éb") for _ in range(60)), "en", "s", 1, 2, "k", 3, 4) for k in range(300)]
    table = docs.union(spark.createDataFrame(extra, KIND))
    for r in pii.detect(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
        base = brute_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert {*base} <= {*r.spans.split(",")} or not base
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in pii.KINDS)
    assert pii.detect(none).count() == 0
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert "[email]" in clean[204].text and "c.org" not in clean[204].text and clean[200].text is None
    assert clean[204].n_chars == len(clean[204].text)


def test_sharding(docs, none):
    got = sharding.shard(docs).collect()
    assert len(got) == len(ROWS) and sharding.shard(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values()) and {*by} <= {*range(24)}
    text = {r[0]: r[1] or "" for r in ROWS}
    assert all(r["size"] == len(text[r.doc_id].encode()) + 8 for r in got)
    assert all(len({r.shard for r in got if text[r.doc_id] == t}) == 1 for t in set(text.values()))


def test_packing_fits_and_is_tight():
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    free, want = [], []  # one group at a time, bins tried one by one
    for s in sizes:
        fits = [(room, b) for b, room in enumerate(free) if room >= s]
        b = min(fits)[1] if fits else len(free)
        free[b:] = free[b:] or [200]
        free[b] -= s
        want.append((s, b))
    got = [(s, b) for s, n, b in sharding.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 200) for _ in range(n)]
    assert Counter(got) == Counter(want) and len(free) <= -(-sum(sizes) // 200) + 1
    assert sharding.best_fit_decreasing([(5, 1), (2, 3)], 4) == [(5, 1, 0), (2, 2, 1), (2, 1, 2)]  # above the capacity: alone
    assert sharding.best_fit_decreasing([(3, 4)], 4, 3) is None
    placed = sharding.pack(sorted(Counter(sizes).items(), reverse=True), 7)
    load = Counter()
    for s, n, b in placed:
        load[b] += s * n
    assert sum(load.values()) == sum(sizes) and max(load.values()) <= 1.05 * sum(sizes) / 7


def test_bpe(docs, none):
    with open(BPE, "rb") as f:
        exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    text = {r[0]: r[1] or "" for r in ROWS}
    got = bpe.encode_decode(docs, BPE).collect()
    assert len(got) == len(ROWS) and bpe.encode_decode(none, BPE).count() == 0
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == exact.encode_ordinary(text[r.doc_id])
        assert r.decoded.decode() == text[r.doc_id]


def test_bpe_on_odd_texts():
    with open(BPE, "rb") as f:
        coder = bpe.Coder(f.read())
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    letters = " \n\t'sltrevmdaB1２é中!.- 　😀\x1c\x00ǅ'  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, "'" * 300 + "ll", " " * 999]
    for t, (ids, ends) in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(t)
        assert not t or np.frombuffer(ends, "<u4")[-1] == len(t)


def vectors(spark, n=400, dim=16):
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    x[100:140] = x[0] + 0.1 * x[100:140]
    x[200:210] = x[5]
    out = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    odd = [(n, None, 0, 1), (n + 1, [0.0] * dim, 0, 1), (n + 2, [float("nan")] * dim, 0, 1), (n + 3, [None] * dim, 0, 1), (n + 4, [], 0, 1)]
    return spark.createDataFrame(out + odd, "vec_id long, embedding array<float>, label int, node long"), x.astype(float)


def test_neighbours(spark):
    table, x = vectors(spark)
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -2
        hits += len({v for v, _ in got[q].values()} & {*np.lexsort((np.arange(len(s)), -s.round(12)))[:5].tolist()})
        assert all(v[1] == pytest.approx(s[v[0]]) for v in got[q].values()) and len(got[q]) == 5
    assert hits >= 0.9 * 5 * len(range(0, len(x), 50)) and got.keys() == {*range(0, len(x), 50)}
    assert neighbours.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_near_duplicates(spark):
    table, x = vectors(spark)
    got = {r.vec_id: r for r in neardup.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([min([root[i], *root[links[i]]]) for i in range(len(u))])
        if (new == root).all():
            break
        root = new
    assert all(got[i].n_links == links[i].sum() and got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(u)))
    assert all(got[len(u) + k].n_links == 0 and got[len(u) + k].kept for k in range(5)) and len(got) == len(u) + 5
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_jaccard(spark, docs, none):
    long = [f"z{k}" for k in range(120)]
    near = []
    for k in range(40):
        w = list(long)
        for _ in range(k % 5):
            w[rng.randrange(120)] = f"q{rng.randrange(50)}"
        near.append((500 + k, " ".join(w), "en", "s", 1, 2, "k", 3, 4))
    table = docs.union(spark.createDataFrame(near, KIND))
    text = {r.doc_id: (r.text or "").lower() for r in table.collect()}
    sets = {}
    for i, t in text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in range(50):
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
        break
    for _ in range(10):
        for i in sets:
            root[i] = root[root[i]]
    got = jaccard.linked(table).collect()
    assert len(got) == table.count() and jaccard.linked(none).count() == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}
    kept = [r.doc_id for r in jaccard.one_of_each(table).collect()]
    assert sorted(kept) == sorted({*root.values()})


def test_one_of_each_component_stays_whatever_its_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    table = [
        (None, text("a")), (None, text("b")), (None, text("b") + " more"), (7, text("c")), (None, text("c")),
        (1, text("d")), (2, text("d") + " more"), (2, text("e")), (3, text("e") + " more"), (4, text("f")), (4, text("g")), (4, text("g")),
        (None, None), (None, ""), (None, " "), (None, " "), (5, None), (5, ""), (5, ""),
    ]
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()), key=repr)
    b = {t for i, t in got if i is None and t and t.startswith("b0")}
    assert len(b) == 1 and b < {text("b"), text("b") + " more"}
    want = [(None, text("a")), (None, *b), (7, text("c")), (1, text("d")), (2, text("e")), (4, text("f")), (4, text("g")), (None, None), (None, ""), (None, " "), (None, " "), (5, None), (5, "")]
    assert got == sorted(want, key=repr)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(24)] + [(100, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(ROWS) and quality.score(none, labels).count() == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score(docs, labels.limit(0)).filter("score = 0.5").count() == len(ROWS)
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_rules_separate(spark):
    x = np.random.default_rng(1).normal(size=(800, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(float)
    model = quality.RuleModel.fit(x, y, ["a", "b", "c"])
    table = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    assert table.filter((model.column() >= 0.5) == (F.col("y") == 1)).count() >= 790


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0
    total = sum(r["size"] for r in got)
    goals = {}
    for r, source in zip(sorted(got, key=lambda r: r.doc_id), sorted(ROWS, key=lambda r: r[0])):
        assert r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        goals[source[3]] = r.target
    assert sum(goals.values()) == pytest.approx(1.5 * total)
