"""Language identification by segmentation-marginalised unigrams.

Pieces are those of a fixed public vocabulary. Each language has a probability for each piece; the probability of a
word is the sum over all its segmentations into pieces (a forward algorithm), and that of a text the product over its
words, since no piece spans a word's begin. Probabilities come from expectation-maximisation over all words of a sample of texts
with known language, counted by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.work import Scratch, held_out

#: Runs of letters and, as ``re`` knows no category, numerals like a superscript, which ``letters`` takes out.
RUNS = re.compile(r"[^\W\d_]+")
MARK, SAFE = "▁", 40  # the vocabulary's word begin; up to so many letters no product underflows, longer words carry a scale


def letters(text: str) -> Iterator[str]:
    """The words of a text: runs of letters (Unicode category L)."""
    for run in RUNS.findall(text):
        yield from [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters (with or without the word-begin mark) in a public piece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if (q := p.removeprefix(MARK)).isalpha() and q == q.lower()})


class Unigrams:
    """Piece probabilities by language; ``marginals`` gives words' log probabilities, summed over all segmentations.

    Words of one length are one matrix of code points. Hashes of all their substrings grow by one column at a time and
    are looked up in the vocabulary's sorted hashes behind a bit table, so the forward algorithm runs over whole columns.
    """

    STEP, BITS, RUN = np.uint64(0x9E3779B97F4A7C15), 20, 4096

    def __init__(self, pieces: list[str], langs: list[str], most: int = 300_000):
        self.langs, self.most, self.longest = langs, most, max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.hashes = np.sort(hashes)
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[self.hashes >> np.uint64(64 - self.BITS)] = True
        self.unknown = 1e-7  # of a character that no piece covers
        self.p = np.full((len(pieces) + 1, len(langs)), 1 / max(1, len(pieces)))
        self.p[-1] = 0
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def _hash(self, piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = (h + np.uint64(ord(c) + 1)) * self.STEP
            h ^= h >> np.uint64(29)
        return int(h[0])

    def edges(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length, the piece of each substring (begin, end), the last row of p for none."""
        points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        n, out = points.shape[1], {}
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = (h + points[:, j]) * self.STEP
                h ^= h >> np.uint64(29)
                maybe = np.flatnonzero(self.known[h >> np.uint64(64 - self.BITS)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                    right = self.hashes[at] == h[maybe]
                    if right.any():
                        ids = np.full(len(words), len(self.hashes))
                        ids[maybe[right]] = at[right]
                        out[i, j + 1] = ids
        return out

    def forward(self, words: list[str], edges: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(words[0]) + 1
        alpha = np.zeros((n + 1, len(words), len(self.langs)))
        alpha[0] = 1
        alone = []
        none = np.full(len(words), len(self.hashes))
        for i in range(n):
            alone.append((edges.get((i, i + 1), none) == len(self.hashes)) * self.unknown)
            alpha[i + 1] += alpha[i] * alone[i][:, None]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (ids := edges.get((i, j))) is not None:
                    alpha[j] += alpha[i] * self.p[ids]
        return alpha, alone

    def pieces_of(self, word: str) -> list[list[tuple[int, int]]]:
        """For each begin in one long word, the (end, piece) of its substrings that are pieces; all substrings of one length at once."""
        points = np.frombuffer((MARK + word).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        n, h = len(points), np.zeros(len(points), np.uint64)
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for size in range(1, min(n, self.longest) + 1):
            h = (h[: n - size + 1] + points[size - 1 :]) * self.STEP
            h ^= h >> np.uint64(29)
            maybe = np.flatnonzero(self.known[h >> np.uint64(64 - self.BITS)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            right = self.hashes[at] == h[maybe]
            for i, piece in zip(maybe[right].tolist(), at[right].tolist()):
                out[i].append((i + size, piece))
        return out

    def logs_of(self, found: list[list[tuple[int, int]]], back: bool = False) -> np.ndarray:
        """Logs of the forward (or backward) sums of one long word at each place, so that no length underflows."""
        n = len(found)
        steps: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i, own in enumerate(found):
            for j, piece in [*own, *([] if any(j == i + 1 for j, _ in own) else [(i + 1, -1)])]:
                steps[i if back else j].append((j if back else i, piece))
        with np.errstate(divide="ignore"):
            p = np.log(self.p)
        p[-1] = np.log(self.unknown)
        out = np.full((n + 1, len(self.langs)), -np.inf)
        out[n if back else 0] = 0
        for i in range(n - 1, -1, -1) if back else range(1, n + 1):
            at, piece = zip(*steps[i])
            out[i] = np.logaddexp.reduce(out[list(at)] + p[list(piece)], axis=0)
        return out

    def runs(self, words) -> Iterator[list[str]]:
        words = sorted(words, key=len)
        while words:
            size = next((k for k, w in enumerate(words) if len(w) != len(words[0])), len(words))
            yield words[: min(size, self.RUN)]
            words = words[min(size, self.RUN) :]

    def learn(self, counts: list[tuple[str, int, int]], rounds: int = 3, smooth: float = 0.1) -> None:
        """Expectation-maximisation over (word, language, count)."""
        weight: dict[str, np.ndarray] = {}
        for word, lang, n in counts:
            for part in letters(word):
                weight.setdefault(part, np.zeros(len(self.langs)))[lang] += n
        long = {w: self.pieces_of(w) for w in weight if len(w) > SAFE}
        runs = [(run, self.edges(run), np.stack([weight[w] for w in run])) for run in self.runs(w for w in weight if w not in long)]
        for _ in range(rounds):
            expected = np.zeros_like(self.p)
            for word, found in long.items():
                alpha, beta = self.logs_of(found), self.logs_of(found, True)
                for i, own in enumerate(found):
                    for j, piece in own:
                        with np.errstate(divide="ignore"):
                            expected[piece] += weight[word] * np.exp(alpha[i] + np.log(self.p[piece]) + beta[j] - alpha[-1])
            for run, edges, times in runs:
                alpha, alone = self.forward(run, edges)
                beta = np.zeros_like(alpha)
                beta[-1] = 1
                scale = times / np.maximum(alpha[-1], 1e-300)
                for i in range(len(alpha) - 2, -1, -1):
                    beta[i] += beta[i + 1] * alone[i][:, None]
                    for j in range(i + 1, min(len(alpha) - 1, i + self.longest) + 1):
                        if (ids := edges.get((i, j))) is not None:
                            part = self.p[ids] * beta[j]
                            beta[i] += part
                            part *= alpha[i] * scale
                            for x in range(len(self.langs)):
                                expected[:, x] += np.bincount(ids, part[:, x], len(expected))
            expected = expected[:-1] + smooth
            self.p[:-1] = expected / expected.sum(0)

    def marginals(self, words) -> tuple[list[str], np.ndarray]:
        order, logs = [], [np.zeros((0, len(self.langs)))]
        for word in (w for w in words if len(w) > SAFE):
            order.append(word)
            logs.append(self.logs_of(self.pieces_of(word))[-1:])
        for run in self.runs(w for w in words if len(w) <= SAFE):
            alpha, _ = self.forward(run, self.edges(run))
            order += run
            logs.append(np.log(np.maximum(alpha[-1], 1e-300)))
        return order, np.vstack(logs)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [list(letters((t or "").lower())) for t in texts]
        new = set().union(*found) - self.seen.keys() if self.langs else set()
        if new and len(self.seen) + len(new) > self.most:
            self.clear()
            new = set().union(*found)
        if new:
            order, logs = self.marginals(new)
            self.seen.update(zip(order, range(len(self.logs), len(self.logs) + len(order))))
            self.logs = np.vstack([self.logs, logs])
        langs, scores = [], []
        for own in found:
            if not own or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.logs[np.fromiter(map(self.seen.__getitem__, own), np.int64, len(own))].sum(0)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            langs.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return langs, scores


def word_counts(docs: DataFrame, texts: int) -> DataFrame:
    """(lang, word, n): counts of all words of the ``texts`` texts of each language that come first by a hash of the id.

    The driver learns how many texts each language has and where its sample ends, a number for each language, as it does the model;
    texts go through no shuffle.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = known.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("order"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def up_to(ends: dict[str, int]) -> F.Column:
        table = F.create_map(*[F.lit(x) for pair in ends.items() for x in pair])
        return F.col("order") <= F.try_element_at(table, F.col("lang"))

    if not sizes:
        return known.select("lang", F.col("text").alias("word"), F.lit(0).alias("n")).limit(0)
    near = {lang: (1 << 40) * min(1.0, (2 * texts + 100) / n) for lang, n in sizes.items()}
    ranked = known.filter(up_to(near)).select("lang", "order").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
    ends = {r.lang: r.end for r in ranked.filter(F.col("rank") <= texts).groupBy("lang").agg(F.max("order").alias("end")).collect()}
    split = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return known.filter(up_to(ends)).select("lang", split.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, pieces: str, texts: int = 1000) -> Unigrams:
    rows = word_counts(docs, texts).collect()  # the words of ``texts`` texts a language
    langs = sorted({r.lang for r in rows})
    model = Unigrams(vocabulary(pieces), langs)
    model.learn([(r.word, langs.index(r.lang), r.n) for r in sorted(rows)])
    return model


def identify(docs: DataFrame, pieces: str, texts: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang); ``pieces``: a public piece model.

    Learns from ``texts`` texts of each language, whole and with all their words. A text that is null or has no letter (Unicode
    category L) is 'und' with score 0; very long texts are read whole, word by word; repeated rows score alike; of equally
    likely languages the first by name is taken; a null lang is not learned from; a null doc_id counts as an empty one;
    with nothing to learn from all are 'und'; an empty table gives no rows. Other columns are not read.
    """
    Scratch(docs.sparkSession)
    model = fit(docs, pieces, texts)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the fixed vocabulary times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                langs, scores = own.score(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
