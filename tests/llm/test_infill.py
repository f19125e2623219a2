"""Fill-in-the-middle against a direct version, with pieces of a few characters."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm.infill import MIDDLE, PREFIX, SUFFIX, _told_apart, infilled, outputs, restored

TEXTS = [(None, None), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "äöü€😀" * 40), (5, "has <M> inside"), (6, "cut < P > and <P"), (7, "x<S>y"), (8, "line\nline\n" * 3000), (None, "no id")]


def direct(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    else:
        form = "spm" if h[3] % 100 < 20 else "psm"
        out, sizes = (f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), (low, high - low)
    return doc_id, n, form, *sizes, out


def test_equal_to_a_direct_version(spark):
    rows = TEXTS + [(100 + i, f"text number {i} <" + "ab<" * i) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, piece string").repartition(3)
    wanted = sorted((direct(i, t) for i, t in rows), key=repr)
    hashed = sorted(((*w[:5], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), w in ((r, direct(*r)) for r in rows)), key=repr)
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    for chunk in (1, 7, 1 << 16):
        assert sorted((tuple(r) for r in infilled(docs, chunk).collect()), key=repr) == hashed
        made = outputs(docs, chunk)
        assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted(((w[0], w[2], w[5]) for w in wanted), key=repr)
    assert sorted((tuple(r) for r in restored(made).collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert infilled(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert restored(spark.createDataFrame([(1, "psm", "no marks")], "doc_id long, form string, output string").select("*")).first().text is None


@given(st.text("<PSM>ab", max_size=12), st.text("<PSM>ab", max_size=12), st.text("<PSM>ab", max_size=12), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_marks_cut_by_pieces(p, m, s, size):
    if any(x in p + m + s for x in (PREFIX, SUFFIX, MIDDLE)):
        return
    for form, out in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
        got = sorted(enumerate(_told_apart(form, (out[i : i + size] for i in range(0, len(out), size)))), key=lambda x: (x[1][0], x[0]))
        assert "".join(piece for _, (_, piece) in got) == p + m + s
