"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node, named by a hash, which keeps its least ids. Each node begins with the best of the cells it falls into under a
few random rotations and of four small cells of random nodes, so that none begins alone. A round of NN-descent then joins every
node's neighbours, both ways, to the node (a Spark join of neighbours of neighbours): whoever meets there, at least one
of them new, and is closer than what it has becomes a candidate, and each node keeps its best. Rounds end when few edges
still change. A query walks the graph from its own node: each hop is a Spark join of the nodes it opens with the graph, and
a beam of the best nodes seen is kept, wider for larger tables. Walks compare 8-bit codes; the best of the beam are scored
on the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.neardup import cells, layout
from cohortlake.llm.vectors import classes, cosine, matrix, name_of, unit, usable, wide
from cohortlake.llm.work import Scratch


def codes(v: np.ndarray) -> np.ndarray:
    """Signed 8-bit codes of unit vectors."""
    return np.rint(v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-30) * 127).astype(np.int8)


def directions(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _code_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1)


def _triples(u, v, s) -> dict:
    cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return {"u": cat(u, pa.int64()), "v": cat(v, pa.int64()), "s": cat(s, pa.float32())}


def _cell(table: pa.Table, k: int) -> pa.Table:
    """The best k partners of every node in one block of a cell."""
    node, x = np.asarray(table["node"]), directions(_code_matrix(table["code"]))
    u, v, s = [], [], []
    for i in range(0, len(node), 512):
        near = x[i : i + 512] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -2
        most = min(k, len(node) - 1)
        if most > 0:
            best = np.argpartition(-near, most - 1, 1)[:, :most]
            u.append(np.repeat(node[i : i + 512], most))
            v.append(node[best].ravel())
            s.append(np.take_along_axis(near, best, 1).ravel())
    return pa.table(_triples(u, v, s))


def first_graph(nodes: DataFrame, n: int, dim: int, k: int, tables: int, cell: int = 1024) -> DataFrame:
    """(u, v, s): partners from the cells of ``tables`` rotations and from four small cells of random nodes, which overlap so
    that the graph hangs together."""
    bits, _ = layout(n, 0.9, cell, 0.9)
    few = F.lit(max(1, n // (k // 2 + 2)))
    scattered = nodes.select("node", "code", F.explode(F.sequence(F.lit(-4), F.lit(-1))).alias("t")).withColumn("cell", F.pmod(F.xxhash64("node", "t"), few))

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                own = cells(directions(_code_matrix(batch.column(1))), bits, tables)
                at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)), pa.array(own.ravel())], ["node", "code", "t", "cell"])

    spread = scattered
    if tables:
        spread = nodes.select("node", "code").mapInArrow(deal, "node long, code binary, t int, cell long").union(scattered)
    # a block holds 2 * cell rows or so; the hash deals a cell with many rows to many blocks
    sizes = spread.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int").alias("blocks"))
    spread = spread.join(sizes, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return spread.groupBy("t", "cell", "block").applyInArrow(lambda table: _cell(table, k), "u long, v long, s float")


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k best v of every u; fresh if an edge is in no row with fresh = 0."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """(u, v, fresh): a node's neighbours, and k at most of the nodes whose neighbour it is, those nearest."""
    back = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    turned = graph.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= k).select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    return graph.select("u", "v", "fresh").union(turned).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))


def _lists(batch, name: str):
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.offsets) - column.offsets[0].as_py(), column.flatten()


def _meet(batches, most: int):
    """Local join: partners closer to a member than the worst it has."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, ids = _lists(batch, "ids")
        _, raw = _lists(batch, "codes")
        _, worst = _lists(batch, "worst")
        _, fresh = _lists(batch, "fresh")
        ids, worst, fresh, x = np.asarray(ids), np.asarray(worst), np.asarray(fresh) > 0, directions(_code_matrix(raw))
        u, v, s = [], [], []
        for a, b in zip(at[:-1], at[1:]):
            if b - a < 2:
                continue
            near = x[a:b] @ x[a:b].T
            near[np.ix_(~fresh[a:b], ~fresh[a:b])] = -2  # these have met before
            np.fill_diagonal(near, -2)
            top = np.argpartition(-near, min(most, b - a - 1) - 1, 1)[:, :most]
            value = np.take_along_axis(near, top, 1)
            p, q = np.nonzero(value > worst[a:b, None])
            u.append(ids[a:b][p])
            v.append(ids[a:b][top[p, q]])
            s.append(value[p, q])
        yield pa.RecordBatch.from_pydict(_triples(u, v, s))


def descend(graph: DataFrame, nodes: DataFrame, k: int, most: int) -> DataFrame:
    """One round of NN-descent."""
    worst = graph.groupBy("u").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("m"))
    known = nodes.select("node", "code").join(worst, nodes["node"] == worst["u"], "left").select(F.col("node").alias("v"), "code", F.when(F.col("m") >= k, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    around = both_ways(graph, k).join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "code", "worst", "fresh")).alias("m"))
    met = around.select(F.col("m.v").alias("ids"), F.col("m.code").alias("codes"), F.col("m.worst").alias("worst"), F.col("m.fresh").alias("fresh"))
    met = met.filter(F.exists("fresh", lambda x: x > 0)).mapInArrow(lambda b: _meet(b, most), "u long, v long, s float")
    return best(graph.withColumn("fresh", F.lit(0)).union(met.withColumn("fresh", F.lit(1))), k)


def build(nodes: DataFrame, scratch: Scratch, k: int = 20, tables: int = 4, most: int = 6, settled: float = 0.05) -> DataFrame:
    """(u, v, s, fresh): the neighbour graph of ``nodes`` (node, code). Rounds end when at most a share of ``settled`` of the
    edges is new; each round but the last replaces more edges than that by closer ones, so they do end."""
    n, dim = nodes.agg(F.count(F.lit(1)), F.max(F.octet_length("code"))).first()
    graph = scratch.save(best(first_graph(nodes, n, dim or 1, k, tables).withColumn("fresh", F.lit(1)), k))
    while True:
        new = scratch.save(descend(graph, nodes, k, most))
        scratch.free(graph)
        graph = new
        edges, changed = graph.agg(F.count(F.lit(1)), F.coalesce(F.sum("fresh"), F.lit(0))).first()
        if changed <= settled * edges:
            return graph


STATE = "q long, code binary, ids array<long>, sims array<float>, open array<boolean>, next array<long>"


def _score(batches):
    """Codes of the query against those of a node's neighbours."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = directions(_code_matrix(batch.column(1)))
        at, ids = _lists(batch, "ids")
        _, raw = _lists(batch, "codes")
        sims = np.einsum("ij,ij->i", directions(_code_matrix(raw)), np.repeat(own, np.diff(at), 0)) if len(ids) else np.zeros(0, np.float32)
        offsets = pa.array(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.asarray(ids), pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(sims, pa.float32()))], ["q", "ids", "sims"])


def _advance(batches, beam: int, opened: int):
    """Merges what a hop found into each query's beam and chooses what to open next."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ids = np.array((r["ids"] or []) + [x for part in r["new_ids"] or [] for x in part], np.int64)
            sims = np.array((r["sims"] or []) + [x for part in r["new_sims"] or [] for x in part], np.float32)
            is_open = np.array((r["open"] or []) + [True] * (len(ids) - len(r["ids"] or [])), bool)
            _, at = np.unique(ids, return_index=True)  # of a node met again, the first: with its own flag
            at = at[np.lexsort((ids[at], -sims[at]))][:beam]
            ids, sims, is_open = ids[at], sims[at], is_open[at]
            take = np.flatnonzero(is_open)[:opened]
            is_open[take] = False
            rows.append({"q": r["q"], "code": r["code"], "ids": ids.tolist(), "sims": sims.tolist(), "open": is_open.tolist(), "next": ids[take].tolist()})
        kind = pa.schema([("q", pa.int64()), ("code", pa.binary()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("open", pa.list_(pa.bool_())), ("next", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(rows, kind)


def walk(starts: DataFrame, graph: DataFrame, nodes: DataFrame, scratch: Scratch, k: int, beam: int, opened: int) -> DataFrame:
    """(q, ids, sims): the beam of each of ``starts`` (q, code) after a greedy walk from its own node. A walk ends when all of
    its beam has been opened."""
    known = nodes.select(F.col("node").alias("v"), "code")
    around = both_ways(graph, k).join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "code")).alias("m"))
    around = around.select(F.col("u").alias("node"), F.col("m.v").alias("ids"), F.col("m.code").alias("codes"))
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    around = around.repartition(parts, "node").persist()
    one = [F.array(F.col("q")).alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("open"), F.array(F.col("q")).alias("next")]
    state, ended = scratch.save(starts.select("q", "code", *one)), []
    while not state.isEmpty():
        front = state.select("q", "code", F.explode("next").alias("node"))
        found = front.join(around, "node").select("q", "code", "ids", "codes").mapInArrow(_score, "q long, ids array<long>, sims array<float>")
        found = found.groupBy("q").agg(F.collect_list("ids").alias("new_ids"), F.collect_list("sims").alias("new_sims"))
        new = scratch.save(state.drop("next").join(found, "q", "left").mapInArrow(lambda b: _advance(b, beam, opened), STATE))
        ended.append(new.filter(F.size("next") == 0).select("q", "ids", "sims"))
        state = new.filter(F.size("next") > 0)
    around.unpersist()
    out = starts.select("q", F.array(F.col("q")).alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims")).limit(0)
    for part in ended:
        out = out.union(part)
    return scratch.save(out)


def search(rows: DataFrame, is_query, top: int = 5, k: int = 20, tables: int = 4, settled: float = 0.05, beam: tuple[int, float, float] = (160, 6, 0.4), share: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row of ``rows`` (vec_id, embedding) that
    ``is_query`` (a Column) selects, among all other rows, ties to the smaller vec_id.

    ``beam`` (least, a, b): walks keep the larger of least and a * n ** b of the n distinct vectors, as a fixed beam finds
    ever less in larger tables; a hop opens a ``share``-th of the beam. Of a beam, which its codes order, the first 10 * ``top`` are scored on
    the original vectors. Vectors that are null, empty or zero or hold a null or non-finite component, and rows
    without vec_id, take no part; a shorter vector counts as filled up with zeros. Copies of a vector are one node, whose
    least ids stand for all, as no others can be among the nearest. Of a vec_id with several vectors, one (that of the
    least name) asks and the nearest counts as found; none is found by itself. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.filter("vec_id IS NOT NULL")
    asked = rows.filter(is_query).filter(usable()).groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min(name_of()).alias("node"))
    rows = rows.select("vec_id", "embedding")
    kept = classes(rows, top + 1).select("node", "ids", "v")
    dim = rows.filter(usable()).agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0]

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes(wide(unit(matrix(batch.column(2))), dim))], pa.binary())], ["node", "ids", "v", "code"])

    nodes = scratch.save(kept.mapInArrow(coded, f"node long, ids array<long>, v {kept.schema['v'].dataType.simpleString()}, code binary"))
    graph = build(nodes, scratch, k, tables, settled=settled)
    asked = scratch.save(asked)
    starts = asked.select(F.col("node").alias("q")).distinct().join(nodes.select(F.col("node").alias("q"), "code"), "q")
    least, factor, power = beam
    most = max(least, int(factor * nodes.count() ** power))
    beams = walk(starts, graph, nodes, scratch, k, most, -(-most // share))
    likely = beams.select("q", F.explode(F.slice("ids", 1, 10 * top)).alias("node"))
    pairs = likely.join(nodes.select("node", "ids", "v"), "node").join(nodes.select(F.col("node").alias("q"), F.col("v").alias("w")), "q")
    scored = pairs.withColumn("score", cosine("w", "v")).select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    out = asked.join(near, asked["node"] == near["q"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
