"""Repair of conversations against exhaustive dynamic programming, whole, cut into segments and cut by borders of partitions."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm.dialogue import audit_of, damaged, intact, repair, repaired, search

DATA = "/root/testdata/sf0.01"
SPACE = " \t\n\v\f\r"
sys.setrecursionlimit(20_000)  # of the brute force


def cheapest(rows):
    """Least (cost, audit) over all edits; rows are (initial, must be deleted, truncated)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def take(letter, cost, after):
            if after is not None:
                out.append((cost + after[0], letter + after[1]))

        made = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if inserted < 4:
            take("I", 2, best(i, made, inserted + 1))
        if i < len(rows):
            initial, must, cut = rows[i]
            take("D", 3, best(i + 1, state, 0))
            if not must:
                take("R", 2 + cut, best(i + 1, made, 0))
                if (state, initial) in step:
                    take("K", cut, best(i + 1, step[state, initial], 0))
        return min(out, default=None)

    return best(0, 0, 0)


def brute(table, harm=True):
    """The whole result for rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20 if harm else 9
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        rows += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            marks.append((role[:1], fault in (0, 1), fault == 2))
        initials = [m[0] for m in marks]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(marks))
        made, at = [], 0
        for letter in audit:
            role, text = rows[at][1:] if letter != "I" else (None, "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter in "IR":
                role = "assistant" if made and made[-1][0][:1] == "u" else "user"
            made.append((role, text))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(text):
    return tuple((c.lower(), c == "x", c.isupper()) for c in text)


@given(st.text("suaoSUAOx", max_size=9))
@settings(max_examples=600, deadline=None)
def test_search(rows):
    assert search(rows) == cheapest(rows_of(rows))


@given(st.text("suuaaaoSUAOx", min_size=3, max_size=16), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_segments(rows, size):
    assert audit_of(rows, size) == search(rows)


def test_long_rows_end_soon():
    r = random.Random(1)
    rows = "".join(r.choices("uuaaasUAox", k=2000))
    assert audit_of(rows) == audit_of(rows, 50)


def made(n, seed):
    r = random.Random(seed)
    out = [(None, None, None, None), (None, 2, "user", "a."), (1, None, "user", "hello."), (1, None, "user", "again"), (2, 5, "system", " \t"), (2, 5, "system", " \t"), (3, 1, "", "x."), (4, 1, "tool", "same."), (4, 3, "tool", "same."), (4, 9, "assistant", "é" * 30_000 + "!")]
    for i in range(n):
        for t in range(r.randint(1, 9)):
            out.append((10 + i, t, r.choice(["user", "assistant", "assistant", "user", "system", "usher"]), r.choice(["Yes.", "no", "What? ", " ", "Long text " * 30 + "."])))
    for t in range(300):  # one long conversation
        out.append((5, t, r.choice(["user", "assistant"]), f"line {r.randint(0, 150)}" + r.choice([".", "!", "", "\n"])))
    return out


@pytest.mark.parametrize("parts,size,held", [(1, 64, 4096), (7, 16, 50), (40, 3, 8)])
def test_equal_to_brute_force(spark, parts, size, held):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = made(60, parts)
        t = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, part string, idx int")
        assert sorted((tuple(r) for r in repaired(damaged(t), False, size, held).collect()), key=repr) == brute(table)
        assert sorted((tuple(r) for r in repaired(intact(t), False, size, held).collect()), key=repr) == brute(table, False)
        told = {}
        for r in sorted(repaired(damaged(t), True, size, held).collect(), key=lambda r: r.place):
            told.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert {c[0]: c[-1] for c in brute(table) if c[0] in told} == {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in told.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repair(t.limit(0)).count() == 0


def test_given_conversations(spark):
    t = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert sorted((tuple(r) for r in repair(t).collect()), key=repr) == brute([(r.conv_id, r.turn, r.role, r.text) for r in t.collect()])
