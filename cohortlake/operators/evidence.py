"""Text evidence: fixed chunks, BM25 over postings for many queries at once, and statistics read from claims."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.longform import saved


def chunks(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """key, chunk, start, end, text of windows of ``size`` characters; those shorter than ``least`` once trimmed are dropped."""
    step = max(1, size - overlap)
    rows = docs.filter(F.length(text) > 0).select(key, F.col(text).alias("t"), F.posexplode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).alias("chunk", "start"))
    rows = rows.select(key, "chunk", "start", F.least(F.col("start") + size, F.length("t")).alias("end"), F.expr(f"substring(t, start + 1, {size})").alias("text"))
    return rows.filter(F.length(F.trim("text")) >= least)


def terms(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def postings(docs: DataFrame, key: str, text: str, tokens=terms) -> DataFrame:
    """d, len, term, tf: the index of a corpus, to be written once and searched often; ``search`` reads it."""
    rows = docs.select(F.col(key).alias("d"), tokens(F.col(text)).alias("w"))
    return rows.select("d", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("d", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def search(index: DataFrame, size: DataFrame, asked: DataFrame, top: int, k1: float, b: float, boost: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """q, d, score, rank from an index, (n, avg) of the corpus and (q, term). boost (d, factor) multiplies a document's score, once.

    Postings are dealt by document before queries meet them, so what moves grows with the postings and not with the queries that share a term."""
    frequent = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    wanted = asked.join(frequent, "term")
    few = asked.count() <= MOST_TERMS
    hits = (index.repartition("d").join(F.broadcast(wanted), "term") if few else index.join(wanted, "term")).crossJoin(F.broadcast(size))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = hits.groupBy("q", "d").agg(F.sum(part).alias("score"))
    if boost is not None:
        scored = scored.join(boost, "d", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    return _placed(scored.withColumn("score", F.round("score", 6)), top, least)


def _placed(scored: DataFrame, top: int, least: float | None) -> DataFrame:
    """The ``top`` rows of every q with a score of ``least`` or more, and their rank; ties by d."""
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))).filter(F.col("rank") <= top)


#: So many rows of (query, term) at most (some 16 MB) are sent to every task; more are joined by shuffle.
MOST_TERMS = 500_000


def counted(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """d, factor, len, ids, tfs of (d, factor, w): the number of a document's words, and which of ``wanted`` (by place) it has, how often. A document is
    counted where it is, so no word moves."""
    known = pa.array(wanted, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("w")
            n = pc.list_value_length(lists)
            hit = pc.index_in(lists.flatten(), value_set=known)
            rows = np.repeat(np.arange(len(lists)), pc.fill_null(n, 0).to_numpy(zero_copy_only=False))[hit.is_valid().to_numpy(zero_copy_only=False)]
            cells, tf = np.unique(rows * len(known) + hit.drop_null().to_numpy(), return_counts=True)
            edges = pa.array(np.searchsorted(cells, np.arange(len(lists) + 1) * len(known)), pa.int32())
            ids, tfs = (pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (cells % max(1, len(known)), tf))
            yield pa.RecordBatch.from_arrays([part.column("d"), part.column("factor"), n.cast(pa.int32()), ids, tfs], names=["d", "factor", "len", "ids", "tfs"])

    return docs.select("d", "factor", "w").mapInArrow(run, f"d {docs.schema['d'].dataType.simpleString()}, factor double, len int, ids array<int>, tfs array<int>")


#: So many scores or hits of a block of documents are held at once in a task.
CELLS = 2_000_000


def best(held: DataFrame, asked: pa.Table, wanted: list[str], idf: np.ndarray, average: float, top: int, k1: float, b: float, kind: str) -> DataFrame:
    """q, d, score: of what ``counted`` gave, each task's ``top`` documents of every query. A block of documents is scored for all queries at once,
    and a task keeps each query's best so far; ties by d, nulls first."""
    asks = asked.column("q").combine_chunks().dictionary_encode()
    place = pc.index_in(asked.column("term").combine_chunks(), value_set=pa.array(wanted, asked.schema.field("term").type)).to_numpy()
    order = np.argsort(place, kind="stable")
    queries, who = asks.dictionary, asks.indices.to_numpy()[order].astype(np.int64)
    first = np.searchsorted(place[order], np.arange(len(wanted) + 1))
    fan = np.diff(first)

    def block(d: pa.Array, factor: np.ndarray, row: np.ndarray, term: np.ndarray, part: np.ndarray, least: np.ndarray) -> pa.Table:
        times = fan[term]
        ends = np.cumsum(times)
        asker = who[np.repeat(first[term] - (ends - times), times) + np.arange(times.sum())]
        plain = np.bincount(np.repeat(row, times) * len(least) + asker, np.repeat(part, times), len(d) * len(least)).reshape(len(d), len(least))
        score = np.floor(plain * factor[:, None] * 1e6 + 0.5) / 1e6
        if len(d) > top:
            least = np.maximum(least, np.partition(score, len(d) - top, axis=0)[len(d) - top])
        doc, q = np.nonzero((plain > 0) & (score >= least))
        return pa.table({"q": q, "score": score[doc, q], "d": d.take(pa.array(doc))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, least = None, np.full(len(queries), -np.inf)
        for batch in batches:
            factor, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("factor", "len"))
            term, tf = (batch.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy())])
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            part = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / average))
            hits = np.bincount(row, fan[term], len(batch))
            step = max(1, int(CELLS // max(len(queries), hits.max(initial=1))))
            for i in range(0, len(batch), step):
                j = min(i + step, len(batch))
                own = slice(ends[i], ends[j])
                new = block(batch.column("d").slice(i, j - i), factor[i:j], row[own] - i, term[own], part[own], least)
                if not len(new):
                    continue
                kept = new if kept is None else pa.concat_tables([kept, new])
                kept = kept.take(pc.sort_indices(kept, sort_keys=[("q", "ascending"), ("score", "descending"), ("d", "ascending")], null_placement="at_start"))
                q = kept.column("q").to_numpy()
                place = np.arange(len(q)) - np.searchsorted(q, q)
                last = place == top - 1
                least[q[last]] = kept.column("score").to_numpy()[last]
                kept = kept.filter(pa.array(place < top))
        if kept is not None:
            kept = kept.set_column(0, "q", queries.take(kept.column("q").combine_chunks())).select(["q", "d", "score"])
            yield from kept.combine_chunks().to_batches()

    return held.mapInArrow(run, f"q {kind}, d {held.schema['d'].dataType.simpleString()}, score double")


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, qtext: str, top: int = 5, k1: float = 1.5, b: float = 0.75, tokens=terms, query_tokens=None, factor: F.Column | None = None, least: float | None = None) -> DataFrame:
    """qkey, key, score, rank: the ``top`` documents for every query; ties by key. ``factor`` of a document multiplies its score, once.

    Texts are read once: one row a document, with its length and the words that a query holds, is saved, and all else comes from it. Documents are scored where
    they are, and only each task's best ones are dealt by query. Repeated keys, or too many words for one task, are searched by ``search``."""
    asked = saved(queries.select(F.col(qkey).alias("q"), F.explode(F.array_distinct((query_tokens or tokens)(F.col(qtext)))).alias("term")).distinct())
    words = docs.select(F.col(key).alias("d"), (F.lit(1.0) if factor is None else factor).cast("double").alias("factor"), tokens(F.col(text)).alias("w"))
    if asked.count() <= MOST_TERMS:
        pairs = asked.toArrow()
        wanted = sorted(set(pairs.column("term").to_pylist()))
        held = saved(counted(words, wanted))
        if held.groupBy("d").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            size = held.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
            df = np.zeros(len(wanted))
            for r in held.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row a word of queries
                df[r.term] = r.df
            scored = best(held, pairs, wanted, np.log((size.n - df + 0.5) / (df + 0.5) + 1), size.avg, top, k1, b, asked.schema["q"].dataType.simpleString())
            return _placed(scored, top, least).select(F.col("q").alias(qkey), F.col("d").alias(key), "score", "rank")
        none = F.lit(None).cast("int")
        rows = held.select("d", "factor", "len", F.explode(F.concat(F.array(F.struct(none.alias("ids"), none.alias("tfs"))), F.arrays_zip("ids", "tfs"))).alias("t"))
        names = docs.sparkSession.createDataFrame(list(enumerate(wanted)), "id int, term string")
        rows = rows.select("d", "factor", "len", F.col("t.ids").alias("id"), F.coalesce("t.tfs", F.lit(1)).alias("c")).join(F.broadcast(names), "id", "left")
    else:
        none = F.lit(None).cast("string")
        wanted = asked.select("term").distinct().unionByName(docs.sparkSession.range(1).select(none.alias("term"))).select(F.col("term").alias("_w"))
        rows = words.select("d", "factor", F.size("w").alias("len"), F.explode(F.concat(F.array(none), F.coalesce("w", F.array().cast("array<string>")))).alias("term"), F.lit(1).alias("c"))
        rows = rows.join(wanted, F.col("term").eqNullSafe(F.col("_w")), "left_semi")
    held = saved(rows.groupBy("d", "len", "term").agg(F.sum("c").alias("tf"), F.max("factor").alias("factor")))
    size = held.filter("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum(F.when(F.col("len").isNotNull(), F.col("tf")))).alias("avg"))
    boost = None if factor is None else held.groupBy("d").agg(F.max("factor").alias("factor"))
    found = search(held.filter("term IS NOT NULL"), size, asked, top, k1, b, boost, least)
    return found.select(F.col("q").alias(qkey), F.col("d").alias(key), "score", "rank")


def reported(claims: DataFrame, text: str) -> DataFrame:
    """Adds p_operator, p_value, effect (name, the first that matches in fixed order) and effect_value, as the text states them, null if not."""
    p = r"(?i)\bp(?:[- ]?value)?\s*(<=|>=|<|>|=|≤|≥)\s*(\d*\.?\d+(?:e-?\d+)?)"
    effects = [("hazard_ratio", r"(?i)\b(?:hr|hazard ratio)\s*(?:=|:|of)?\s*(\d*\.?\d+)"), ("odds_ratio", r"(?i)\b(?:or|odds ratio)\s*(?:=|:|of)?\s*(\d*\.\d+)"), ("risk_ratio", r"(?i)\b(?:rr|risk ratio)\s*(?:=|:|of)?\s*(\d*\.?\d+)"), ("cohens_d", r"(?i)\bcohen'?s? d\s*(?:=|:|of)?\s*(-?\d*\.?\d+)"), ("correlation", r"(?i)\br\s*=\s*(-?\d*\.?\d+)"), ("rho", r"(?i)(?:\brho\b|ρ)\s*(?:=|:|of)?\s*(-?\d*\.?\d+)"), ("cramers_v", r"(?i)\b(?:cramer'?s?\s+)?v\s*(?:=|:|of)\s*(\d*\.?\d+)"),
               ("auc", r"(?i)\bauc\s*(?:=|:|of)?\s*(\d*\.?\d+)"), ("smd", r"(?i)\bsmd\s*(?:=|:|of)?\s*(-?\d*\.?\d+)"), ("mean_difference", r"(?i)\bmean difference\s*(?:=|:|of)?\s*(-?\d*\.?\d+)")]
    t = F.col(text)
    got = [(name, F.nullif(F.regexp_extract(t, rule, 1), F.lit(""))) for name, rule in effects]
    operator, value = F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.expr("try_cast(p_text AS double)")
    out = claims.withColumn("p_operator", F.replace(F.replace(operator, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))).withColumn("p_text", F.nullif(F.regexp_extract(t, p, 2), F.lit(""))).withColumn("p_value", value).drop("p_text")
    out = out.withColumn("effect", F.coalesce(*(F.when(v.isNotNull(), F.lit(name)) for name, v in got))).withColumn("effect_value", F.coalesce(*(v for _, v in got)).cast("double"))
    return out
