"""Repeated passages against brute force over all windows, with every path of the refinement forced."""

import hashlib
import random

import pytest

from cohortlake.llm import suffixes

DATA = "/root/testdata/sf0.01"


def brute(rows, length):
    """Removed flags of each row by a dictionary of all windows, rows in the order (doc_id, nulls first)."""
    seen, out = {}, []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = [s for s in "".join(map(str, gone)).split("0") if s]
        out.append((rows[i][0], len(raw), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 9)))
    passages = [" ".join(word() for _ in range(r.randint(12, 60))) for _ in range(5)]
    rows = [(None, passages[0]), (None, None), (7, ""), (7, passages[0] * 2), (7, passages[0]), (8, "é" * 500), (9, "xy" * 400), (10, "short"), (11, "short")]
    texts = []
    for i in range(n):
        k = r.random()
        if texts and k < 0.2:
            t = r.choice(texts)
        elif texts and k < 0.5:
            words = r.choice(texts).split(" ")
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = word()
            t = " ".join(words)
        else:
            t = " ".join([word() for _ in range(r.randint(0, 80))] + [r.choice(passages)] + [word() for _ in range(r.randint(0, 80))])
        texts.append(t)
        rows.append((100 + (i * 7919) % n, t))
    return rows


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 3000, "BLOCK": 700, "UNITS": 50}, {"CHUNK": 9000, "CROWD": 3, "UNITS": 200}, {"CHUNK": 20000, "CHUNK_CROWD": 1}, {"CHUNK": 5000, "CHUNK_CROWD": 0}])
def test_equal_to_brute_force(spark, monkeypatch, limits):
    rows = made(len(limits), 120)
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    for length in (100, 48):
        # local solvers, so that the limits hold in this process
        got = local(rows, length)
        assert got == brute(rows, length)
    assert sum(x[2] for x in got) > 5000


def local(rows, length):
    """The operator's steps without Spark: chunks, both rounds of questions, the removal."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    buckets, chunks = 3, []
    held, size = [], 0
    for i, t in rows:
        held.append((i, (t or "").encode()))
        size += len(held[-1][1])
        if size >= suffixes.CHUNK:
            chunks.append(held)
            held, size = [], 0
    chunks.append(held)
    out = []
    for number, held in enumerate(chunks):
        held = sorted(held, key=lambda x: (x[0] is not None, x[0] or 0))
        ids = np.array([np.iinfo(np.int64).min if i is None else i for i, _ in held], np.int64)
        row = {"chunk": number, "docs": ids.tobytes(), "nulls": np.array([i is None for i, _ in held]).tobytes(), "sizes": np.array([len(b) for _, b in held], np.int64).tobytes(), "body": zstandard.compress(b"".join(b for _, b in held))}
        out.append(suffixes.Chunk(row, length, buckets))

    def solved(asks, solve):
        replies = [{} for _ in out]
        for group in sorted({a[1:3] for a in asks}):
            batch = suffixes._asks([a for a in asks if a[1:3] == group])
            for r in solve(pa.Table.from_batches([batch])).to_pylist():
                replies[r["chunk"]][r["kind"], r["bucket"]] = r["reply"]
        return replies

    first = solved([(c.number, 0, b, c.asked_units(i), None) for c in out for b, i in c.units()], suffixes._solve_units)
    for c, r in zip(out, first):
        c.answer({b: v for (_, b), v in r.items()})
    second = solved([(c.number, k, b, *c.asked_windows(k, i)) for c in out for k, b, i, _ in c.refinements()], suffixes._solve_windows(length))
    result = []
    for c, r in zip(out, second):
        gone = c.removed(r)
        for d, null, a, b in zip(c.docs, c.nulls, c.at[:-1], c.at[1:]):
            g = gone[a:b]
            spans = [s for s in "".join("1" if x else "0" for x in g).split("0") if s]
            result.append((None if null else int(d), int(b - a), int(g.sum()), len(spans), hashlib.sha256(c.raw[a:b][~g].tobytes()).hexdigest()))
    return sorted(result, key=repr)


def test_whole_operator(spark):
    rows = made(9, 300)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, body string")
    assert sorted((tuple(r) for r in suffixes.dedup(docs.coalesce(1)).collect()), key=repr) == brute(rows, 100)
    # the order of rows with one id follows the parts they are read from; here ids are distinct
    own = [(i, t) for i, t in {i: t for i, t in rows}.items()]
    assert sorted((tuple(r) for r in suffixes.dedup(spark.createDataFrame(own, "doc_id long, text string").repartition(5)).collect()), key=repr) == brute(own, 100)
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in suffixes.dedup(docs).collect()), key=repr) == brute(rows, 100)
