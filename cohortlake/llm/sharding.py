"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups of equal texts move as one. Groups of one size are interchangeable, so what is packed is the table of distinct
sizes and their numbers, which has at most sqrt(2 * total bytes) rows however many groups there are. Sizes fall; each group
enters the bin with the least remaining capacity that still holds it, which a balanced tree finds, and the next ones of its
size follow as long as they fit, as that bin stays the tightest. The least capacity that needs no more than the wanted number of bins is
found by halving. The groups of a size are numbered by Spark and take the bins of their size in that order.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.work import Scratch, bucket_of, hash_bits, text_bytes


class Rooms:
    """A balanced tree (treap) of (remaining capacity, bin)."""

    def __init__(self):
        self.root, self.random = None, random.Random(1)

    def _split(self, node, key):
        """Subtrees below ``key``, and from it on."""
        if node is None:
            return None, None
        own, weight, low, high = node
        if own < key:
            a, b = self._split(high, key)
            return (own, weight, low, a), b
        a, b = self._split(low, key)
        return a, (own, weight, b, high)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def add(self, room: int, number: int) -> None:
        a, b = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(a, ((room, number), self.random.random(), None, None)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least entry with room for ``size``."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        _, b = self._split(b, (node[0][0], node[0][1] + 1))
        self.root = self._merge(a, b)
        return node[0]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, number of groups, bin) in packing order for ``runs`` of (size, number), sizes descending; None if
    ``most_bins`` do not do. A group above the capacity gets a bin alone."""
    rooms, bins, out = Rooms(), 0, []
    for size, n in runs:
        while n:
            if (found := rooms.take(size)) is None:
                if bins == most_bins:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, number = found
            fit = min(n, room // size)
            out.append((size, fit, number))
            rooms.add(room - fit * size, number)
            n -= fit
    return out


def pack(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """As ``best_fit_decreasing`` under the least capacity, to 1 in 20,000 of a share, that fits ``bins``."""
    if not runs:
        return []
    low = max(-(-sum(s * n for s, n in runs) // bins), runs[0][0])
    if best := best_fit_decreasing(runs, low, bins):
        return best
    high, step = low + runs[0][0], max(1, low // 20_000)
    while (best := best_fit_decreasing(runs, high, bins)) is None:
        high *= 2
    while high - low > step:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(runs, mid, bins)) is None:
            low = mid
        else:
            high, best = mid, found
    return best


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row of ``docs`` (doc_id, text).

    Null text counts and groups as an empty one; repeated rows all get slots of their own; ties of size and slot go by hashes, so
    reruns agree; very long texts are only hashed and measured; an empty table gives no rows. Other columns are not
    read. Shards are as equal as indivisible groups allow: one group may exceed a share.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = text_bytes(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"))
    rows = scratch.save(rows)
    groups = scratch.save(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    n = groups.count()
    table = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()  # sqrt(2 * total) rows at most
    segments, first = [], {}
    for size, count, number in pack(sorted(((r.bytes, r.n) for r in table), reverse=True), shards):
        at = first.get(size, 0)
        segments.append((size, at, at + count, number))
        first[size] = at + count
    segments = spark.createDataFrame(segments, "bytes long, low long, high long, shard int")
    numbered = placed(groups.withColumn("key", F.hex("digest")), ["bytes"], "rank", n, 64)
    where = numbered.join(segments, "bytes").filter("low <= rank AND rank < high").select("digest", "shard")
    out = rows.join(where, "digest").select("doc_id", "size", "text_crc32", "shard", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.hex("digest"))).alias("key"))
    out = placed(scratch.save(out), ["shard"], "slot", rows.count(), 64 * shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def placed(rows: DataFrame, by: list[str], name: str, n: int, per_bucket: int) -> DataFrame:
    """Adds ``name``, gapless from 0 within ``by``, in the order of key: offsets of hash buckets plus a row number inside one."""
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), hash_bits(n, per_bucket)))
    counts = rows.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*by, "bucket").orderBy("key")
    return rows.join(offsets, [*by, "bucket"]).withColumn(name, (F.col("offset") + F.row_number().over(inside) - 1).cast("long")).drop("bucket", "offset")
