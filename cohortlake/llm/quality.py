"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text are taken with NumPy over Arrow batches. Boosted shallow trees are fitted on a bounded
sample of labelled rows; every path of a tree is a rule (a conjunction of thresholds), a logistic regression with an L1
penalty keeps few of them, and these compile into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.batches import chunks, shingles, words
from cohortlake.llm.work import Scratch, held_out

STATS = ["words", "word_bytes", "upper", "digit", "symbol", "pipe", "shout", "mark", "distinct", "repeated", "again", "top_word", "line_words", "stops"]


def _classes() -> np.ndarray:
    of = np.zeros((256, 8))
    groups = [range(65, 91), [*range(65, 91), *range(97, 123)], range(48, 58), [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()"], [ord("|")], [ord("!")], [ord(c) for c in "#$%&*"], [ord("."), 10]]
    for k, group in enumerate(groups):
        of[list(group), k] = 1
    return of


_CLASSES = _classes()


def text_statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATS`` for each text; null and empty texts give zeros."""
    out = np.zeros((len(column), len(STATS)))
    for i, j, raw, at in chunks(column):
        starts, _, hashes, firsts = words(raw, at)
        runs = shingles(hashes)
        for k in range(i, j):
            a, b, w, v = at[k - i], at[k - i + 1], firsts[k - i], firsts[k - i + 1]
            if v == w:
                continue
            upper, letters, digit, symbol, pipe, shout, mark, stop = np.bincount(raw[a:b], minlength=256) @ _CLASSES
            n, size, own = v - w, b - a, hashes[w:v]
            _, counts = np.unique(own, return_counts=True)
            again = runs[w : max(w, v - 4)]
            out[k] = (
                np.log1p(n), size / n, upper / max(letters, 1), digit / size, symbol / size, pipe / n, shout / n, mark / n, len(counts) / n,
                float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0, 1 - len(np.unique(again)) / len(again) if len(again) else 0.0, counts.max() / n,
                n / (1 + np.count_nonzero(raw[a:b] == 10)), stop / n,
            )
    return out


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, whose names do not begin with stat_, and STATS of every row."""
    kept = [f for f in docs.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = text_statistics(batch.column(len(kept)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(x) for x in stats.T.copy())], [*(f.name for f in kept), *(f"stat_{s}" for s in STATS)])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"stat_{s} double" for s in STATS]
    return docs.select(*(f.name for f in kept), text).mapInArrow(run, ", ".join(kinds))


def _tree(x: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """(rules of all paths as lists of (feature, threshold, above), value of each row) of a regression tree on bins."""
    rules: list[list[tuple[int, float, bool]]] = []
    value = np.zeros(len(grad))

    def grow(rows: np.ndarray, path: list, left: int) -> None:
        if path:
            rules.append(path)
        best, g, h = (1e-6, -1, -1), grad[rows].sum(), hess[rows].sum()
        if left and len(rows) >= 2 * least:
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                code = x[rows, f]
                gs, hs, ns = (np.bincount(code, w, len(edge) + 1).cumsum()[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            value[rows] = g / (h + 1)
            return
        _, f, cut = best
        low = x[rows, f] <= cut
        grow(rows[low], [*path, (f, float(edges[f][cut]), False)], left - 1)
        grow(rows[~low], [*path, (f, float(edges[f][cut]), True)], left - 1)

    grow(np.arange(len(grad)), [], depth)
    return rules, value


def _holds(x: np.ndarray, rule) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, t, above in rule])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal steps; the intercept is free."""
    n = len(y)
    design = np.hstack([x, np.ones((n, 1))])
    rate = 4 * n / (np.linalg.norm(design, 2) ** 2 + 1e-9)
    w = z = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = z - rate * (design.T @ (_sigmoid(design @ z) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], w[-1]


class RuleModel:
    """Rules over named statistics with weights; ``column`` is the Spark expression of its probability."""

    def __init__(self, names: list[str], rules: list, weights: np.ndarray, bias: float):
        self.names, self.rules, self.weights, self.bias = names, rules, weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3) -> RuleModel:
        """Fits on rows x with labels y (0 to 1). One class or no rows give a constant: the share of 1, or 0.5."""
        share = float(y.mean()) if len(y) else 0.5
        bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        if not len(y) or y.min() == y.max():
            return cls(names, [], np.zeros(0), bias)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1], method="lower")) for c in x.T]
        edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        score, rules = np.full(len(y), bias), {}
        for _ in range(trees):
            p = _sigmoid(score)
            found, value = _tree(codes, edges, y - p, p * (1 - p), depth, max(2, len(y) // 500))
            score += rate * value
            rules |= {tuple(sorted(r)): None for r in found}
        rules = list(rules)
        on = np.stack([_holds(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
        fold = np.arange(len(y)) % 4 == 0
        losses = {}
        for penalty in (0.0003, 0.001, 0.003, 0.01):
            w, b = _lasso(on[~fold], y[~fold], penalty)
            p = np.clip(_sigmoid(on[fold] @ w + b), 1e-6, 1 - 1e-6)
            losses[penalty] = -np.mean(y[fold] * np.log(p) + (1 - y[fold]) * np.log(1 - p))
        w, b = _lasso(on, y, min(losses, key=losses.get))
        kept = np.flatnonzero(np.abs(w) > 1e-4)
        return cls(names, [rules[k] for k in kept], w[kept], float(b))

    def column(self) -> Column:
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            test = None
            for f, t, above in rule:
                one = F.col(self.names[f]) > F.lit(t) if above else F.col(self.names[f]) <= F.lit(t)
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = 20_000) -> RuleModel:
    """Fits on ``most`` labelled ids at most that are not held out, the first by a hash of the id; of several rows with one id, on
    one of them. Several labels of one id count as their mean."""
    votes = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    votes = votes.withColumn("order", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    share = min(1.0, (1.5 * most + 100) / max(1, votes.count()))
    # thinned by the hash first, so that no more than about 1.5 * most rows meet for the exact cut
    sample = scratch.save(votes.filter(F.col("order") <= share * (1 << 40)).orderBy("order", "doc_id").limit(most).select("doc_id", "y"))
    names = [f"stat_{s}" for s in STATS]
    few = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # ``most`` rows of an id and a number
    rows = statistics(few).groupBy("doc_id").agg(F.min(F.struct(*names, "y")).alias("x")).select("x.*")
    x = rows.toPandas()[[*names, "y"]].sort_values([*names, "y"]).to_numpy(float)
    return RuleModel.fit(x[:, :-1], x[:, -1], names)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts score by zero statistics; very long texts are read whole; repeated rows score alike; a null doc_id counts as an
    empty id and is never learned from; without labels every score is 0.5; an empty table gives no rows. Other columns
    are not read.
    """
    p = train(docs, labels, Scratch(docs.sparkSession), most).column()
    rows = statistics(docs.select("doc_id", "text")).select("doc_id", held_out().alias("held_out"), p.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, whatever their names.

    Nulls, empty and very long texts, repeated rows and empty tables are as in ``score``; a row stays or goes by its own text, so
    repeated rows share their fate.
    """
    p = train(docs, labels, Scratch(docs.sparkSession), most).column()
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name of a column clashes with a statistic's
    rows = statistics(plain.withColumn("text", F.col(f"c{docs.columns.index('text')}")))
    return rows.filter(p >= threshold).select(*plain.columns).toDF(*docs.columns)
