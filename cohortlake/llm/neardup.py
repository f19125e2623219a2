"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o, filled up with zeros to D components, is rotated at random and replaced by its signs: the code stands
for the unit vector x = signs / sqrt(D). Stored with it are the factor f = <x, o> and the rotated vector in 4-bit steps,
rounded at random so that it is right in the mean. <x, q> / f is then an unbiased estimate of <o, q>, and it errs by more
than e * sqrt((1 - f^2) / f^2 / (D - 1)) with a probability that falls as exp(-c e^2). A pair is settled by the codes if
even this bound leaves it below the threshold; all others are recomputed on the original vectors in double precision.

Candidates share the first bits of one of several other rotations. The number of bits grows with the number of vectors,
so that a cell has about ``cell`` rows, and the number of tables with the bits, so that a pair at the threshold is met
with probability ``recall`` at least. A pair counts in the first table where it meets only. Cells hold codes, dealt in blocks;
vectors are fetched by name for the pairs left open or, where a block has more of them than ``dense`` a row (so that most
of it is a group of copies), for the block, from which counts and one edge a vector come, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.components import components
from cohortlake.llm.vectors import classes, cosine, matrix, name_of, rotation, unit, usable, wide
from cohortlake.llm.work import Scratch


def layout(n: int, threshold: float, cell: int, recall: float) -> tuple[int, int]:
    """(bits of a cell, tables)."""
    bits = min(62, max(0, math.ceil(math.log2(max(1, n) / cell))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))
    return bits, tables


def cells(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table."""
    out = np.zeros((len(v), tables), np.int64)
    for t in range(tables):
        planes = np.random.default_rng(1000 + t).normal(size=(v.shape[1], bits)) if bits > v.shape[1] else rotation(v.shape[1], 1000 + t)[:, :bits]
        out[:, t] = ((v @ planes) > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return out


def codes(v: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Sign bits, factor, 4-bit steps of the rotated vector, their offset and width, for unit vectors."""
    turned = v @ rotation(v.shape[1], seed)
    signs = turned > 0
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / 15, 1e-12)
    steps = np.clip(np.floor((turned - low) / step + np.random.default_rng(seed).random(turned.shape)), 0, 15).astype(np.uint8)
    factor = np.abs(turned).sum(1) / math.sqrt(v.shape[1])
    return {"signs": np.packbits(signs, 1), "factor": factor, "steps": steps[:, ::2] | (steps[:, 1::2] << 4), "low": low[:, 0], "step": step[:, 0]}


def coded(nodes: DataFrame, dim: int, bits: int, tables: int) -> DataFrame:
    """node, copies, cells (of all tables), code of every row of ``nodes`` (node, copies, v)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = unit(matrix(batch.column(2)))
                own, c = cells(wide(v, dim), bits, tables), codes(wide(v, max(128, dim + dim % 2)))
                numbers = np.stack([c["factor"], c["low"], c["step"]], 1).astype("<f4").view(np.uint8).reshape(len(v), -1)
                packed = np.hstack([numbers, c["signs"], c["steps"]])
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary())], ["node", "copies", "cells", "code"])

    return nodes.select("node", "copies", "v").mapInArrow(run, "node long, copies long, cells binary, code binary")


def _rows(table: pa.Table, name: str, kind) -> np.ndarray:
    raw = table[name].to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def estimates(packed: np.ndarray, other: np.ndarray, dim: int, errors: float) -> np.ndarray:
    """Upper bounds of the inner products of the vectors coded in ``packed`` with those in ``other``."""
    factor = np.ascontiguousarray(packed[:, :12]).view("<f4")[:, 0]
    x = np.unpackbits(packed[:, 12 : 12 + -(-dim // 8)], axis=1)[:, :dim].astype(np.float32) * 2 - 1
    low, step = np.ascontiguousarray(other[:, :12]).view("<f4")[:, 1:].T
    nibbles = other[:, 12 + -(-dim // 8) :]
    steps = np.empty((len(other), dim), np.float32)
    steps[:, ::2], steps[:, 1::2] = nibbles & 15, nibbles >> 4
    turned = low[:, None] + step[:, None] * steps
    root = np.float32(math.sqrt(dim))
    bound = errors * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1))
    rounding = errors * step / 2  # a step is off by half its width or so, in either direction
    return x @ turned.T / (root * factor[:, None]) + bound[:, None] + rounding[None, :] / factor[:, None] + 1e-5


def _open(table: pa.Table, dim: int, threshold: float, errors: float, dense: int) -> pa.Table:
    """The pairs that the codes leave open in a cell, or in a pair of its blocks; one row with null names instead if they are
    more than ``dense`` a row."""
    t, cell, i, j = (table[c][0].as_py() for c in ("t", "cell", "i", "j"))
    node, block = np.asarray(table["node"]), np.asarray(table["block"])
    packed, own = _rows(table, "code", np.uint8), _rows(table, "cells", "<i8")
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found, size = [], 0
    for k in range(0, len(first), 1024):
        x, y = np.nonzero(estimates(packed[first[k : k + 1024]], packed[second], dim, errors) >= threshold)
        x, y = first[k + x], second[y]
        if i == j:
            x, y = x[node[x] < node[y]], y[node[x] < node[y]]
        if t:
            new = np.concatenate([~(own[x[m : m + 65536], :t] == own[y[m : m + 65536], :t]).any(1) for m in range(0, len(x), 65536)] or [np.zeros(0, bool)])
            x, y = x[new], y[new]
        found.append((node[x], node[y]))
        size += len(x)
        if size > dense * len(node):
            return pa.table({"t": pa.array([t], pa.int32()), "cell": pa.array([cell], pa.binary()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
    a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    every = lambda x, kind: pa.array([x] * len(a), kind)
    return pa.table({"t": every(t, pa.int32()), "cell": every(cell, pa.binary()), "i": every(i, pa.int32()), "j": every(j, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _join(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Union of the sets of p and q in a forest of least indices."""
    while len(p):
        a, b = parent[p], parent[q]
        p, q = p[a != b], q[a != b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
    return parent


def _exact(table: pa.Table, threshold: float) -> pa.Table:
    """Links, counted with copies, and one edge for every vector of a block pair, from the original vectors."""
    t, i, j = (table[c][0].as_py() for c in ("t", "i", "j"))
    node, copies, block = (np.asarray(table[c]) for c in ("node", "copies", "block"))
    own, v = _rows(table, "cells", "<i8"), unit(matrix(table["v"]))
    counts, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for k in range(0, len(first), 256):
        x, y = np.nonzero(v[first[k : k + 256]] @ v[second].T >= threshold)
        x, y = first[k + x], second[y]
        if i == j:
            x, y = x[node[x] < node[y]], y[node[x] < node[y]]
        parent = _join(parent, x, y)
        for m in range(0, len(x), 65536):
            p, q = x[m : m + 65536], y[m : m + 65536]
            new = ~(own[p, :t] == own[q, :t]).any(1) if t else np.ones(len(p), bool)
            np.add.at(counts, p[new], copies[q[new]])
            np.add.at(counts, q[new], copies[p[new]])
    low = node[parent]
    hit = np.flatnonzero((counts > 0) | (low != node))
    return pa.table({"node": node[hit], "links": counts[hit], "low": low[hit]})


def links(nodes: DataFrame, scratch: Scratch, threshold: float, cell: int, recall: float, block: int, errors: float, dense: int) -> DataFrame:
    """(node, links, low): partial numbers of links, with copies, and an edge to another or the same node."""
    n, dim = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    bits, tables = layout(n, threshold, cell, recall)
    stored = scratch.save(coded(nodes, dim, bits, tables))
    spread = stored.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("cell", F.expr("substring(cells, 8 * t + 1, 8)"))
    deal = spread.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("t", "cell", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    spread = spread.join(deal, ["t", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    asked = spread.withColumn("ij", F.explode(meets)).select("node", "cells", "code", "t", "cell", "block", "ij.i", "ij.j")
    width = max(128, dim + dim % 2)
    found = asked.groupBy("t", "cell", "i", "j").applyInArrow(lambda x: _open(x, width, threshold, errors, dense), "t int, cell binary, i int, j int, a long, b long")
    found = scratch.save(found)

    v, w = (nodes.select(F.col("node").alias(x), F.col("v").alias(f"v_{x}"), F.col("copies").alias(f"copies_{x}")) for x in "ab")
    pairs = found.filter("a IS NOT NULL").select("a", "b").join(v, "a").join(w, "b").filter(cosine("v_a", "v_b") >= threshold)
    pairs = scratch.save(pairs.select("a", "b", "copies_a", "copies_b"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("copies_b").alias("links"), F.least("a", "b").alias("low")), F.struct(F.col("b").alias("node"), F.col("copies_a").alias("links"), F.least("a", "b").alias("low")))
    near = pairs.select(F.inline(ends))

    crowds = found.filter("a IS NULL").select("t", "cell", "i", "j")
    rows = spread.select("node", "copies", "cells", "t", "cell", "block").join(crowds, ["t", "cell"]).filter("block = i OR block = j").join(nodes.select("node", "v"), "node")
    dense_ones = scratch.save(rows.groupBy("t", "cell", "i", "j").applyInArrow(lambda x: _exact(x, threshold), "node long, links long, low long"))
    return near.union(dense_ones)


def near_duplicates(rows: DataFrame, threshold: float = 0.9, cell: int = 1024, recall: float = 0.999, block: int = 4096, errors: float = 5.0, dense: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding).

    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing; equal vectors are
    compared once and link with each other; a shorter vector counts as filled up with zeros. A vec_id with several
    vectors names each of them, and each row has the links of its own vector. A row with a null vec_id takes no part: 0 links, no
    component, kept. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(rows.sparkSession)
    rows = rows.select("vec_id", "embedding")
    nodes = scratch.save(classes(rows.filter("vec_id IS NOT NULL"), 1))
    found = links(nodes, scratch, threshold, cell, recall, block, errors, dense)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), scratch)
    each = nodes.select("node", "copies", F.element_at("ids", 1).alias("id")).join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = each.groupBy("root").agg(F.min("id").alias("component"))
    each = each.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    own = rows.select("vec_id", F.when(usable() & F.col("vec_id").isNotNull(), name_of()).alias("node"))
    out = own.join(each, "node", "left")
    component = F.coalesce(F.col("component"), F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
