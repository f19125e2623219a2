"""Shared parts of the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> F.Column:
    """Whether a vector is neither null, empty nor zero and all its components are finite numbers."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def name_of(embedding: str = "embedding") -> F.Column:
    """A vector's name: 64 bits of a hash of its components."""
    return F.xxhash64(embedding)


def cosine(a: str, b: str) -> F.Column:
    """Cosine of two vector columns in double precision; the shorter one counts as filled up with zeros."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: zero(p) * zero(q)), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(node, ids, copies, v) for each distinct usable vector: its name, its ``keep`` least ids, the number of its
    rows, and the vector. Copies meet in partial aggregates, at most ``keep`` ids of each, whatever their number."""
    good = rows.filter(usable()).select(name_of().alias("node"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    one = [F.count(F.lit(1)).alias("n"), F.first("v").alias("v")]
    if keep == 1:
        return good.groupBy("node").agg(F.array(F.min("id")).alias("ids"), *one).select("node", "ids", F.col("n").alias("copies"), "v")
    # ids within a share of their hash first, so that no list grows with the number of copies
    parts = good.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(64)).alias("share")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"), *one)
    whole = parts.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"), F.sum("n").alias("copies"), F.first("v").alias("v"))
    return whole.select("node", "ids", "copies", "v")


def matrix(column) -> np.ndarray:
    """A pyarrow list column of vectors as a matrix. Shorter vectors are filled up with zeros, which changes no product."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(column):
        return np.zeros((0, 0))
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    if (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max()), flat.dtype)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def wide(v: np.ndarray, dim: int) -> np.ndarray:
    """``v`` with zero columns up to ``dim``."""
    return v if v.shape[1] == dim else np.hstack([v, np.zeros((len(v), dim - v.shape[1]), v.dtype)])


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))
