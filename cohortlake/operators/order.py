"""Ordered work without a task that holds a group: running sums over ranges of rows, and exact counts of ordered pairs."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.longform import need, saved

AGGREGATES = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}


def _join(kind: str, a, b) -> F.Column:
    """What a range carries in, and what it has: either may be null."""
    if kind == "min":
        return F.least(a, b)
    if kind == "max":
        return F.greatest(a, b)
    return F.coalesce(a + b if kind == "sum" else a * b, a, b)


class Ranges:
    """Rows dealt by ranges of (``by``, ``order``) and saved, each with the number of its range, ``_range``.

    ``order`` lists names, or (name, False) for falling ones; together with ``by`` they should tell rows apart, as then no value,
    however frequent, binds rows to one range.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list):
        self.by, self.order = list(by), [(o, True) if isinstance(o, str) else o for o in order]
        need(df, *self.by, *(name for name, _ in self.order))
        keys = [F.asc_nulls_first(c) for c in self.by] + [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in self.order]
        self.rows = saved(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))

    def running(self, rows: DataFrame, reverse: bool = False, **items: tuple) -> DataFrame:
        """Adds a column for each of ``items``, name=(kind, column): the sum, product, min or max of all rows of the group up to and
        with this one, or from it on if ``reverse``. ``rows`` are ``self.rows`` or come from them, with ``_range`` kept.

        One window inside each range, one row a range and group, and what they carry to the ranges after them.
        """
        keys = [F.asc_nulls_first(c) if up != reverse else F.desc_nulls_last(c) for c, up in self.order]
        inside = Window.partitionBy("_range", *self.by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        whole = rows.groupBy(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(self.by))).agg(*(AGGREGATES[kind](c).alias(f"_t_{name}") for name, (kind, c) in items.items()))
        before = Window.partitionBy(*(f"_by{i}" for i in range(len(self.by))), F.lit(0)).orderBy(F.desc("_r") if reverse else F.asc("_r")).rowsBetween(Window.unboundedPreceding, -1)
        carried = whole.select("_r", *(f"_by{i}" for i in range(len(self.by))), *(AGGREGATES[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in items.items()))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(self.by)], F.col("_range") == F.col("_r"))
        local = rows.select("*", *(AGGREGATES[kind](c).over(inside).alias(f"_l_{name}") for name, (kind, c) in items.items()))
        return local.join(carried, same).select(*(F.col(f"`{c}`") for c in rows.columns), *(_join(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, (kind, _) in items.items()))


def _above(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> int:
    """Sum of a[i] * b[j] over i < j with rank[i] < rank[j], ranks being 0 to n - 1: two ranks part at one bit, so each level
    of bits adds the pairs that part there, by a running sum inside the groups that agree above it."""
    total, order = 0, np.arange(len(rank))
    for level in reversed(range(int(len(rank)).bit_length())):
        r = rank[order]
        high = (r >> level) & 1 == 1
        upto = np.concatenate([[0], np.cumsum(np.where(high, b[order], 0))])
        group = r >> (level + 1)
        end = np.searchsorted(group, group, "right")  # groups stand in order
        total += int(np.sum(np.where(high, 0, a[order]) * (upto[end] - upto[1:])))
        order = order[np.argsort(r >> level, kind="stable")]
    return total


def _positions(*keys: np.ndarray) -> np.ndarray:
    """The place of each row in the order of ``keys``, the first key counting most."""
    out = np.empty(len(keys[0]), np.int64)
    out[np.lexsort(keys[::-1])] = np.arange(len(out))
    return out


def dominated(cells: DataFrame, x: list[str], y: str, a: str, b: str) -> DataFrame:
    """total: the sum of a_i b_j over all pairs of cells with x_i < x_j and y_i < y_j, exactly. Cells are distinct in (x, y), numbers
    and without nulls; a and b are counts.

    Cells stand in two orders, by x and by y, each with the other falling among equals, so that equal ones never count. Each order
    is cut into ranges. Pairs in different ranges of both are counted on the grid of ranges; pairs in one range of x, and pairs in
    one range of y but different ones of x, inside that range. So each cell is moved four times, whatever their number.
    """
    need(cells, *x, y, a, b)
    rows = cells.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)), F.col(y).cast("double").alias("y"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    names = [f"x{i}" for i in range(len(x))]
    rows = Ranges(rows, [], [*names, ("y", False)]).rows.withColumnRenamed("_range", "u")
    rows = Ranges(rows, [], ["y", *((n, False) for n in names)]).rows.withColumnRenamed("_range", "v")

    def total(n: int) -> pa.Table:
        return pa.table({"total": pa.array([Decimal(n)], pa.decimal128(38, 0))})

    def inside(table: pa.Table, own: str) -> pa.Table:
        c = {k: table[k].to_numpy() for k in table.column_names}
        falling = [-c[n] for n in names]
        if own == "u":
            order = np.lexsort([-c["y"], *(c[n] for n in names[::-1])])
            rank = _positions(c["y"], *falling)[order]
        else:
            order = np.lexsort([*falling[::-1], c["y"]])
            rank = _positions(c["u"][order], -np.arange(len(order)))
        return total(_above(c["a"][order], c["b"][order], rank))

    one = rows.groupBy("u").applyInArrow(lambda t: inside(t, "u"), "total decimal(38,0)")
    other = rows.groupBy("v").applyInArrow(lambda t: inside(t, "v"), "total decimal(38,0)")
    grid = rows.groupBy("u", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ends = rows.agg(F.max("v").alias("most"))
    full = grid.select("u").distinct().crossJoin(F.broadcast(ends)).select("u", F.explode(F.sequence(F.lit(0), "most")).alias("v")).join(grid, ["u", "v"], "left")  # ranges by ranges
    beyond = full.withColumn("up", F.sum("b").over(Window.partitionBy("u").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)))
    beyond = beyond.withColumn("after", F.sum("up").over(Window.partitionBy("v").orderBy(F.desc("u")).rowsBetween(Window.unboundedPreceding, -1)))
    apart = beyond.select((F.col("a").cast("decimal(19,0)") * F.coalesce("after", F.lit(0)).cast("decimal(19,0)")).alias("total"))
    return one.unionByName(other).unionByName(apart).agg(F.coalesce(F.sum(F.col("total").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"))
