"""Personal data by weak supervision.

Fixed patterns give base spans, which always stand. Wider patterns give further candidates. On every candidate four
labelers vote for, against or not at all: its shape, gazetteers (top-level domains, dial codes, issuer digits, reserved
networks), the words before it, and its structure. Expectation-maximisation over the counts of vote patterns, taken by
Spark over all documents, estimates how reliable each labeler is. Its posteriors are the soft labels of a logistic span classifier
for each kind, fitted on a bounded sample of candidates. The classifier sees the votes weighed by the estimated reliabilities and what no labeler
does: length, digits, separators and the words before, hashed. Its decision says which candidates become spans.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.work import Scratch

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Wider patterns: spelt-out addresses, colon networks, dotted card numbers, national numbers.
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:[\[(]at[\])]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]| dot |\.) ?[A-Za-z0-9-]{2,63})+")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])")
NATIONAL = re.compile(r"(?<![0-9+.\-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9]{0,2}[ -][0-9][0-9 -]{5,14}[0-9](?![0-9])")
#: Gazetteers.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io ai app dev de fr es it uk us eu ch at nl be pt pl se no dk fi ru jp cn in br mx ar ca au nz za example test".split())
DIAL = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 98".split())
CUES = [re.compile(x, re.I) for x in (r"mail|contact|write|correo|courriel|kontakt", r"\bip\b|address|host|server|login|from", r"card|visa|credit|payment|tarjeta|carte|karte", r"phone|call|tel|fax|mobile|cell|llam|appel|anruf")]
AGAINST = re.compile(r"version|isbn|order|invoice|build|serial|section|chapter|sku|\bno\.", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern from the left, in time linear in the text."""
    end, low, at = 0, 0, text.find("@")
    while at >= 0:
        low = max(low, end)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        low = at + 1
        at = text.find("@", at + 1)


def _candidates(text: str) -> Iterator[tuple[int, int, int, bool, str]]:
    """(kind, start, end, base, matched text)."""
    for a, b in emails(text):
        yield 0, a, b, True, text[a:b]
    low = text.lower() if "at" in text or "AT" in text else ""
    if "[at]" in low or "(at)" in low or " dot " in low or "dot)" in low or "dot]" in low:
        for m in SPELT.finditer(text):
            yield 0, m.start(), m.end(), False, m[0]
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in parts):
            yield 1, m.start(), m.end(), True, m[0]
    if ":" in text:
        for m in COLONS.finditer(text):
            yield 1, m.start(), m.end(), False, m[0]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                yield 2, m.start(), m.end(), luhn(digits), m[0]
    for m in DOTTED.finditer(text):
        yield 2, m.start(), m.end(), False, m[0]
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield 3, m.start(), m.end(), True, m[0]
    for m in NATIONAL.finditer(text):
        yield 3, m.start(), m.end(), False, m[0]


def _votes(text: str, kind: int, start: int, end: int, base: bool, found: str) -> int:
    """The four votes (0 none, 1 for, 2 against) as one number."""
    before = text[max(0, start - 40) : start]
    digits = re.sub(r"\D", "", found)
    cue = 1 if CUES[kind].search(before) else 2 if AGAINST.search(before) else 0
    edge = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    if kind == 0:
        host = re.split(r"[.@ ()\[\]]+", found.lower())
        shape, known = (1 if "@" in found or " dot " in found.lower() or found[-1] in ")]" or "(" in found or "[" in found else 2), (1 if host[-1] in TOP_LEVEL or (not host[-1] and host[-2] in TOP_LEVEL) else 2)
        built = 2 if ".." in found or edge else 1
    elif kind == 1:
        parts = found.split(".")
        shape, known = (1 if len(parts) == 4 else 0), (2 if parts[0] in ("0", "00", "127") or found.startswith("0:") else 1)
        built = 2 if edge or any(len(p) > 1 and p[0] == "0" for p in parts if "." in found) else 1
    elif kind == 2:
        shape, known = (1 if len(digits) in (15, 16) else 2), (1 if digits[0] in "3456" else 2)
        built = 1 if luhn(digits) else 2
    else:
        plus = found[0] == "+"
        shape, known = (1 if plus or found[0] == "(" else 0), (1 if not plus or digits.startswith(DIAL) else 2)
        built = 2 if edge or len(set(digits)) < 3 else 1
    return shape + 3 * known + 9 * cue + 27 * built


HASHED = 16  # buckets of the words before a candidate
WORD = re.compile(r"[^\W\d_]+")


def _features(text: str, start: int, found: str) -> list[float]:
    """What the labelers do not look at: length, share of digits and of separators, groups, and the last three words before, hashed."""
    n = len(found)
    digits = sum(c.isdigit() for c in found)
    marks = sum(not c.isalnum() for c in found)
    out = [min(n, 64) / 64, digits / n, marks / n, min(len(found.split()), 8) / 8, float(len(set(found)) > n / 3)]
    words = [0.0] * HASHED
    for w in WORD.findall(text[max(0, start - 48) : start].lower())[-3:]:
        words[zlib.crc32(w.encode()) % HASHED] = 1.0
    return out + words


def find(text: str | None) -> list[tuple[int, int, int, int, bool, list[float]]]:
    """(kind, start, end, votes, base, features) of every candidate; a wider one that meets a base one of its kind is left out."""
    text = text or ""
    found = list(_candidates(text))
    out = []
    bases = {k: [(a, b) for q, a, b, base, _ in found if base and q == k] for k in range(4)}
    at = [0] * 4
    for kind, a, b, base, s in found:
        if not base:
            own = bases[kind]
            while at[kind] < len(own) and own[at[kind]][1] <= a:
                at[kind] += 1
            if at[kind] < len(own) and own[at[kind]][0] < b:
                continue
        out.append((kind, a, b, _votes(text, kind, a, b, base, s), base, _features(text, a, s)))
    return out


def _digits(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**k % 3 for k in range(4)], 1)


def reliabilities(codes: np.ndarray, base: np.ndarray, n: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns with counts n: (posterior of each pattern, [class, labeler, vote] probabilities)."""
    votes = _digits(codes)
    post = np.where(base, 0.9, np.where((votes == 1).sum(1) > (votes == 2).sum(1) + 1, 0.6, 0.25))
    table = np.zeros((2, 4, 3))
    for _ in range(rounds):
        prior = np.clip((post * n).sum() / n.sum(), 0.02, 0.98)
        for c, w in ((1, post * n), (0, (1 - post) * n)):
            for k in range(4):
                counts = np.bincount(votes[:, k], w, 3) + 0.5
                table[c, k] = counts / counts.sum()
        logs = [np.log(table[c][np.arange(4), votes]).sum(1) for c in (0, 1)]
        z = np.log(prior / (1 - prior)) + logs[1] - logs[0]
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        post = np.where(base, np.maximum(post, 0.9), post)  # what the patterns fix is true
    return post, table


def _design(codes: np.ndarray, features: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-odds of each labeler's vote under the estimated reliabilities, the features, and one."""
    votes = _digits(codes)
    odds = np.log(table[1][np.arange(4), votes] / table[0][np.arange(4), votes])
    return np.hstack([odds, features, np.ones((len(codes), 1))])


def classifier(x: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by gradient steps of a safe length."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    rate = 4 / (np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + 4 * ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (weight * (p - labels)) + ridge * w)
    return w


SPAN = "array<struct<kind:int,start:int,end:int,votes:int,base:boolean,x:array<float>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("base", pa.bool_()), ("x", pa.list_(pa.float32()))]))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found (all candidates) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "votes", "base", "x"), s)) for s in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {SPAN}")


class SpanModel:
    """For each kind the reliabilities of the labelers and the weights of its classifier."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}

    def probabilities(self, kind: int, codes: np.ndarray, features: np.ndarray) -> np.ndarray:
        if kind not in self.weights:
            return np.zeros(len(codes))
        return 1 / (1 + np.exp(-np.clip(_design(codes, features, self.tables[kind]) @ self.weights[kind], -30, 30)))

    def accepts(self, spans: list) -> list[bool]:
        """Whether each of ``find``'s candidates is a span."""
        return [base or bool(self.probabilities(kind, np.array([votes]), np.array([x], float))[0] >= 0.5) for kind, _, _, votes, base, x in spans]


def fitted(found: DataFrame, most: int = 20_000) -> SpanModel:
    """The model of ``candidates``: reliabilities from the vote patterns of all documents (4 * 162 rows), classifiers on about ``most`` candidates
    of each kind, the first by a hash of what they are."""
    model, spans = SpanModel(), found.select(F.explode("found").alias("s")).select("s.*")
    counts = spans.groupBy("kind", "votes", "base").agg(F.count(F.lit(1)).alias("n")).collect()
    whole = {(k, base): sum(r.n for r in counts if r.kind == k and r.base == base) for k in range(4) for base in (True, False)}
    # base and other candidates are thinned apart, as the former are many more
    share = F.coalesce(*(F.when((F.col("kind") == k) & (F.col("base") == base), F.lit(min(1.0, most / 2 / n))) for (k, base), n in whole.items() if n), F.lit(0.0))
    sample = spans.filter(F.pmod(F.xxhash64("kind", "votes", "x", "start", "end"), F.lit(1 << 30)) <= share * (1 << 30)).groupBy("kind", "votes", "base", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    for kind in range(4):
        own = sorted((r.votes, r.base, r.n) for r in counts if r.kind == kind)
        rows = sorted(((r.votes, r.base, list(r.x), r.n) for r in sample if r.kind == kind))
        if not own or not rows:
            continue
        codes, base, n = (np.array(x) for x in zip(*own))
        post, model.tables[kind] = reliabilities(codes, base.astype(bool), n.astype(float))
        label = dict(zip(zip(codes.tolist(), base.astype(bool).tolist()), post.tolist()))
        votes, features = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
        times = np.array([r[3] for r in rows], float)
        model.weights[kind] = classifier(_design(votes, features, model.tables[kind]), np.array([label[r[0], r[1]] for r in rows]), times)
    return model


def _joined(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (numbers of base spans), base_sha256 (of them), spans (base ones and those that the method adds)
    for every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; very long texts are read whole; repeated rows each get a row; a null doc_id stays null; an empty
    table gives no rows. Offsets count code points, ends are exclusive; spans are in order of kind, then begin. Other columns are not
    read.
    """
    found = Scratch(docs.sparkSession).save(candidates(docs))
    model = found.sparkSession.sparkContext.broadcast(fitted(found, most))  # a few hundred numbers

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                ok = model.value.accepts([(s["kind"], s["start"], s["end"], s["votes"], s["base"], s["x"]) for s in spans])
                rows.append([{**s, "x": None} for s, yes in zip(spans, ok) if yes])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW)], ["doc_id", "found"])

    kept = found.mapInArrow(decide, found.schema)
    slim = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    kept = kept.select("doc_id", slim.alias("found"))
    counts = [F.expr(f"cast(size(filter(found, s -> s.base and s.kind = {k})) as long) AS n_{name}") for k, name in enumerate(KINDS)]
    return kept.select("doc_id", *counts, F.sha2(_joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; n_chars, where present, is counted anew.

    Texts are read twice, as the model comes from all of them; nulls, empty and very long texts, repeated rows and empty tables are as in
    ``detect``; other columns stay as they are, whatever their names.
    """
    Scratch(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(candidates(docs), most))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        found = find(text)
        spans = sorted((s[1], s[2], KINDS[s[0]]) for s, yes in zip(found, model.value.accepts(found)) if yes)
        out, end = [], 0
        for a, b, kind in spans:
            if b <= end:
                continue
            if a >= end:
                out += [text[end:a], f"[{kind}]"]
            end = b
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
