"""Repeated passages by bucket-pointer refinement of a sampled suffix array.

A suffix's bucket is named by an identifier of its first bytes. Identifiers of longer prefixes come from those of shorter ones at a
later offset, id(p, a + b) = join(id(p, a), id(p + a, b)), and every identifier made is used again for the next length: 1, 2, 4,
8 and 16 bytes give the initial 24-byte buckets, and these refine to the full length.

Sorting every suffix would shuffle a multiple of the text, so the initial buckets hold a sample that loses nothing: each window
of ``length`` bytes is filed under the suffix inside it whose 24-byte identifier is least, the leftmost of equals. The choice
depends on the window's bytes alone, so equal windows are filed under equal suffixes at the same distance. Neighbouring windows
mostly share a suffix; such a run of windows is a unit, and there is one for some 39 bytes.

1. Units meet in the buckets of their suffixes. Of units with equal bytes all but the first in document order are repeats, whole.
   Buckets whose units are all alike, or which hold one unit, are settled.
2. In the rest the first units are refined to the full length: a bucket gets the bytes of its units and sorts all their
   windows by identifier and document. Crowded buckets are refined before the shuffle: their windows go, each distinct one
   once a chunk, to buckets of the windows' own identifiers, so no task holds a crowd.

Documents lie in chunks of about 1 MB, written once. A chunk asks buckets in compact arrays and is answered in a byte or a bit
for each thing asked, in the order asked, so answers need no keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm import batches
from cohortlake.llm.batches import mix64
from cohortlake.llm.work import Scratch

Q = 24  # bytes of the initial buckets
BLOCK = 1 << 17  # window starts whose identifiers are in memory at once
CHUNK = 1 << 20  # bytes of text in a chunk, unless one document is longer
UNITS = 250_000  # units a bucket's task takes, about
CROWD, CHUNK_CROWD = 4096, 16  # units in a bucket, distinct ones from one chunk, beyond which windows are asked for one by one
_rng = np.random.default_rng(7)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_C, _32, _29, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(32), np.uint64(29), np.uint64(0xFFFFFFFF)
UNIT = np.dtype([("q", "<u8"), ("k", "<u8"), ("doc", "<i8"), ("crowd", "u1")])
WINDOW = np.dtype([("id", "<u8"), ("q", "<u8"), ("doc", "<i8")])
CONTEXT = np.dtype([("q", "<u8"), ("doc", "<i8"), ("size", "<u4")])
FIRST, OPEN, CROWDED = 1, 2, 4
CHUNKS = "chunk long, n_bytes long, docs binary, nulls binary, sizes binary, body binary"
ASK = "chunk long, kind int, bucket long, asked binary, body binary"
REPLY = "chunk long, kind int, bucket long, reply binary"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of joined strings from those of their halves."""
    x = a >> _32
    x ^= a
    x *= _C
    x += b
    x ^= x >> _29
    return x


def _levels(raw: np.ndarray) -> dict[int, np.ndarray]:
    """Identifiers of 1, 2, 4, 8 and 16 bytes at every offset."""
    out = {1: BYTE[raw]}
    for k in (1, 2, 4, 8):
        out[2 * k] = _join(out[k][: max(0, len(out[k]) - k)], out[k][k:])
    return out


def _at(levels: dict[int, np.ndarray], places: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of ``length`` bytes at ``places``."""
    half = 1 << (length.bit_length() - 1)
    if half == length:
        return levels[length][places] if length in levels else _join(_at(levels, places, length // 2), _at(levels, places + length // 2, length // 2))
    return _join(_at(levels, places, half), _at(levels, places + half, length - half))


def _open_starts(at: np.ndarray, length: int, low: int, high: int) -> np.ndarray:
    """For starts low to high - 1, whether a window from there ends inside its row."""
    first, last = at[:-1], at[1:] - length + 1
    near = (last > first) & (last > low) & (first < high)
    step = np.zeros(high - low + 1, np.int32)
    np.add.at(step, np.maximum(first[near], low) - low, 1)
    np.add.at(step, np.minimum(last[near], high) - low, -1)
    return np.cumsum(step[:-1]) > 0


def _units(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, bucket, identifier of all bytes) of each unit, by place."""
    width, parts = length - Q + 1, []
    for x in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = raw[x : x + BLOCK + length - 1]
        n = len(part) - length + 1
        ok = _open_starts(at, length, x, x + n)
        if not ok.any():
            continue
        levels = _levels(part)
        q = mix64(_join(levels[16][: len(part) - Q + 1], levels[8][16:]))
        least = (q & ~_LOW) | np.arange(len(q), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        suffix = (least & _LOW).astype(np.int64)
        change = np.ones(n + 1, bool)
        change[1:-1] = (suffix[1:] != suffix[:-1]) | (ok[1:] != ok[:-1])
        low = np.flatnonzero(change[:-1] & ok)
        high = np.flatnonzero(change[1:] & ok)
        key = mix64(_join(_at(levels, low, length), _at(levels, high, length)) + (high - low).astype(np.uint64))
        parts.append((low + x, high + x, q[suffix[low]], key))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _windows(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Identifiers of all windows of the rows of ``raw``, in order."""
    out = [np.zeros(0, np.uint64)]
    for x in range(0, max(0, len(raw) - length + 1), BLOCK):
        part = raw[x : x + BLOCK + length - 1]
        places = np.flatnonzero(_open_starts(at, length, x, x + len(part) - length + 1))
        out.append(mix64(_at(_levels(part), places, length)))
    return np.concatenate(out)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0]..high[0], low[1]..high[1], ..."""
    n = high - low + 1
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    head = np.ones(len(sorted_keys[0]), bool)
    if len(head):
        head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return head


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(_heads(bucket[order]))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


class Chunk:
    """One chunk's text and what it asks; the same from the same text each time, so answers fit by order alone."""

    def __init__(self, row: dict, length: int, buckets: int):
        self.number, self.length, self.buckets = row["chunk"], length, buckets
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.at = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))]).astype(np.int64)
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8) if self.at[-1] else np.zeros(0, np.uint8)
        self.low, self.high, self.q, self.key = _units(self.raw, self.at, length)
        self.doc = self.docs[np.searchsorted(self.at, self.low, "right") - 1]
        order = np.lexsort((self.key, self.q))
        q, head = self.q[order], _heads(self.q[order], self.key[order])
        group = _heads(q)
        number = np.cumsum(group) - 1
        crowd = np.bincount(number, head)[number] > CHUNK_CROWD if len(q) else group
        self.crowd, self.first, ask = (np.zeros(len(q), bool) for _ in range(3))
        self.crowd[order], self.first[order], ask[order] = crowd, head, np.where(crowd, group, head)
        self.asking = np.flatnonzero(ask)

    def units(self) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, units asked about)."""
        for bucket, i in _by_bucket((self.q[self.asking] % np.uint64(self.buckets)).astype(np.int64)):
            yield bucket, self.asking[i]

    def asked_units(self, i: np.ndarray) -> bytes:
        out = np.zeros(len(i), UNIT)
        out["q"], out["k"], out["doc"], out["crowd"] = self.q[i], self.key[i], self.doc[i], self.crowd[i]
        return out.tobytes()

    def answer(self, replies: dict[int, bytes]) -> None:
        """Takes in what buckets say of units: those that repeat, those to refine in their bucket, those to refine by windows."""
        flags = np.full(len(self.q), 0, np.uint8)
        flags[self.crowd] = FIRST | OPEN | CROWDED
        for bucket, i in self.units():
            flags[i] = np.where(self.crowd[i], flags[i], np.frombuffer(replies[bucket], np.uint8))
        self.repeats = flags & FIRST == 0
        refine = ~self.repeats & (flags & OPEN > 0)
        crowded = refine & (flags & CROWDED > 0)
        self.contexts, crowds = np.flatnonzero(refine & ~crowded), np.flatnonzero(crowded)
        self.places = _spread(self.low[crowds], self.high[crowds])
        self.ids = _windows(*self.bytes_of(crowds), self.length)
        n = (self.high - self.low + 1)[crowds]
        self.window_q, self.window_doc = np.repeat(self.q[crowds], n), np.repeat(self.doc[crowds], n)
        order = np.lexsort((self.places, self.window_q, self.ids))
        again = ~_heads(self.ids[order], self.window_q[order])
        self.again = self.places[order[again]]
        self.window = np.sort(order[~again])

    def bytes_of(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.high[i] - self.low[i] + self.length
        return self.raw[_spread(self.low[i], self.low[i] + sizes - 1)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def refinements(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(kind, bucket, things asked about, places of the windows the answer speaks of)."""
        for bucket, i in _by_bucket((self.q[self.contexts] % np.uint64(4 * self.buckets)).astype(np.int64)):
            i = self.contexts[i]
            yield 1, bucket, i, _spread(self.low[i], self.high[i])
        for bucket, i in _by_bucket((self.ids[self.window] % np.uint64(4 * self.buckets)).astype(np.int64)):
            i = self.window[i]
            yield 2, bucket, i, self.places[i]

    def asked_windows(self, kind: int, i: np.ndarray) -> tuple[bytes, bytes | None]:
        if kind == 2:
            out = np.zeros(len(i), WINDOW)
            out["id"], out["q"], out["doc"] = self.ids[i], self.window_q[i], self.window_doc[i]
            return out.tobytes(), None
        out = np.zeros(len(i), CONTEXT)
        out["q"], out["doc"], out["size"] = self.q[i], self.doc[i], self.high[i] - self.low[i] + self.length
        return out.tobytes(), zstandard.ZstdCompressor(1).compress(self.bytes_of(i)[0].tobytes())

    def removed(self, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
        """For each byte, whether a repeated window covers it."""
        step = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(step, self.low[self.repeats], 1)
        np.add.at(step, self.high[self.repeats] + self.length, -1)
        found = [self.again]
        for kind, bucket, _, places in self.refinements():
            found.append(places[np.unpackbits(np.frombuffer(replies[kind, bucket], np.uint8), count=len(places)).astype(bool)])
        places = np.concatenate(found)
        np.add.at(step, places, 1)
        np.add.at(step, places + self.length, -1)
        return np.cumsum(step[:-1]) > 0


def _chunked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held, size = [], 0

    def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        table = pa.Table.from_batches(held).combine_chunks()
        ids, text = table["doc_id"].combine_chunks(), table["text"].combine_chunks()
        for i, j, raw, at in batches.chunks(text, CHUNK):
            own = ids.slice(i, j - i)
            nulls = own.is_null().to_numpy(zero_copy_only=False)
            docs = own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            order = np.argsort(docs, kind="stable")
            body = b"".join(raw[at[k] : at[k + 1]].tobytes() for k in order)
            columns = [number, len(body), docs[order].tobytes(), nulls[order].tobytes(), np.diff(at)[order].astype(np.int64).tobytes(), zstandard.ZstdCompressor(3).compress(body)]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, [pa.int64(), pa.int64()] + [pa.binary()] * 4)], CHUNKS.replace(",", "").split()[::2])
            number += 1

    for batch in parts:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield from chunk(held)
            held, size = [], 0
    if held:
        yield from chunk(held)


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["chunk", "kind", "bucket", "asked", "body"])


def _replies(table: pa.Table, replies: list[bytes]) -> pa.Table:
    return pa.table([table["chunk"], table["kind"], table["bucket"], pa.array(replies, pa.binary())], ["chunk", "kind", "bucket", "reply"])


def _solve_units(table: pa.Table) -> pa.Table:
    """Of the units in one bucket's task: the first of equal ones, and which suffixes have unlike units or a crowd."""
    asked = [np.frombuffer(b, UNIT) for b in table["asked"].to_pylist()]
    n = np.array([len(a) for a in asked])
    chunk = np.repeat(table["chunk"].to_numpy(), n)
    all_ = np.concatenate(asked)
    normal = all_["crowd"] == 0
    order = np.lexsort((chunk, all_["doc"], all_["crowd"], all_["k"], all_["q"]))
    s = all_[order]
    head = _heads(s["q"], s["k"])
    group = np.cumsum(_heads(s["q"])) - 1
    crowded = (np.bincount(group, s["crowd"]) > 0) | (np.bincount(group) > CROWD)
    open_ = (np.bincount(group, head) > 1) | crowded
    flags = np.empty(len(s), np.uint8)
    flags[order] = head * FIRST + (open_[group] * OPEN + crowded[group] * CROWDED).astype(np.uint8)
    flags[~normal] = 0  # a crowd knows already
    cuts = np.cumsum(n)[:-1]
    return _replies(table, [f.tobytes() for f in np.split(flags, cuts)])


def _solve_windows(length: int):
    def solve(table: pa.Table) -> pa.Table:
        """Of the windows in one bucket's task: all but the first of equal ones are repeats."""
        ids, q, docs, n = [], [], [], []
        for kind, asked, body in zip(table["kind"].to_pylist(), table["asked"].to_pylist(), table["body"].to_pylist()):
            if kind == 2:
                a = np.frombuffer(asked, WINDOW)
                ids.append(a["id"]), q.append(a["q"]), docs.append(a["doc"])
            else:
                a = np.frombuffer(asked, CONTEXT)
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
                sizes = a["size"].astype(np.int64)
                ids.append(_windows(raw, np.concatenate([[0], np.cumsum(sizes)]), length))
                q.append(np.repeat(a["q"], sizes - length + 1)), docs.append(np.repeat(a["doc"], sizes - length + 1))
            n.append(len(ids[-1]))
        chunk = np.repeat(table["chunk"].to_numpy(), n)
        ids, q, docs = np.concatenate(ids), np.concatenate(q), np.concatenate(docs)
        order = np.lexsort((chunk, docs, q, ids))
        again = np.empty(len(ids), bool)
        again[order] = ~_heads(ids[order], q[order])
        return _replies(table, [np.packbits(f).tobytes() for f in np.split(again, np.cumsum(n)[:-1])])

    return solve


def _gathered(replies: DataFrame) -> DataFrame:
    """A chunk's answers in one row: a byte or a bit for each thing it asked, so bounded by the chunk."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "reply")).alias("replies"))


def repeats_removed(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: removed byte ranges (start, end) and the remaining bytes of its text.

    A byte goes if it lies in a string of ``length`` bytes, inside one text, that also starts earlier: in a smaller doc_id, or
    earlier in the text. Null text: empty. Null doc_id: before all others. Rows of the same doc_id count in the order they are
    read, so of equal rows the first stays. Shorter texts than ``length`` keep all. Very long texts are taken whole; only their
    identifiers are in memory in blocks. Empty table: no rows. Columns other than doc_id and text are left out.
    """
    if length < 2 * Q:
        raise ValueError(f"length below {2 * Q}")
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    chunks = scratch.save(texts.mapInArrow(_chunked, CHUNKS))
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = int(total / 39 / UNITS) + 1
    plain = chunks.select("chunk", "docs", "nulls", "sizes", "body")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[dict]]]:
        for part in parts:
            for k in range(part.num_rows):
                row = part.slice(k, 1).to_pylist()[0]
                yield Chunk(row, length, buckets), row.get("replies") or []

    def ask_units(parts):
        for chunk, _ in rows(parts):
            yield _asks([(chunk.number, 0, bucket, chunk.asked_units(i), None) for bucket, i in chunk.units()])

    def ask_windows(parts):
        for chunk, replies in rows(parts):
            chunk.answer({r["bucket"]: r["reply"] for r in replies})
            yield _asks([(chunk.number, kind, bucket, *chunk.asked_windows(kind, i)) for kind, bucket, i, _ in chunk.refinements()])

    def finish(parts):
        for chunk, replies in rows(parts):
            chunk.answer({r["bucket"]: r["reply"] for r in replies if not r["kind"]})
            gone, at = chunk.removed({(r["kind"], r["bucket"]): r["reply"] for r in replies if r["kind"]}), chunk.at
            spans, kept = [], []
            for a, b in zip(at[:-1], at[1:]):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).view(np.int8)))
                spans.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
                kept.append(chunk.raw[a:b][~gone[a:b]].tobytes())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(chunk.docs, mask=chunk.nulls), pa.array(np.diff(at)), pa.array(spans, span), pa.array(kept, pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    first = scratch.save(plain.mapInArrow(ask_units, ASK).groupBy("bucket").applyInArrow(_solve_units, REPLY))
    asked = plain.join(_gathered(first), "chunk", "left").mapInArrow(ask_windows, ASK)
    second = scratch.save(asked.groupBy("kind", "bucket").applyInArrow(_solve_windows(length), REPLY))
    whole = plain.join(_gathered(first.union(second)), "chunk", "left")
    return whole.mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def dedup(docs: DataFrame) -> DataFrame:
    out = repeats_removed(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
