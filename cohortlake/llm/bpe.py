"""Byte-level BPE encoding and decoding.

Pre-tokenisation is a finite automaton run over arrays, without regex: code points become classes (with one or two code
points of look-ahead folded in), each class is a function from state to state, and such functions compose
associatively. Blocks are reduced to one function each, a scan over the blocks gives the state each one begins in, and
a second sweep marks where pieces begin. Slices of the text then go through a cached merge of byte pairs by rank.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortlake.llm.work import Scratch

#: Classes of code points: letter, number, other, apostrophe that begins a two- or three-character ending, white space
#: inside or at the end of a run, last white space before something else (a space, or another), begin of a text.
L, N, O, Q2, Q3, S, SP, SX, Z = range(9)
#: States after a code point: nothing open, in letters, in numbers, in others, after a joining space, in white space,
#: one or two code points of an ending to come.
FRESH, IN_L, IN_N, IN_O, JOIN, GAP, END1, END2 = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by class and state."""
    to, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for state in range(8):
        for cls, inside in ((L, IN_L), (N, IN_N), (O, IN_O), (Q2, IN_O), (Q3, IN_O)):
            to[cls, state], cut[cls, state] = inside, state not in (inside, JOIN)
        for cls, todo in ((Q2, END1), (Q3, END2)):
            if state not in (IN_O, JOIN):
                to[cls, state] = todo
        to[S, state], cut[S, state] = GAP, state != GAP
        to[SP, state], to[SX, state], to[Z, state] = JOIN, FRESH, FRESH
    for cls in range(8):  # the letters of an ending belong to it
        to[cls, END1], cut[cls, END1] = FRESH, False
        to[cls, END2], cut[cls, END2] = END1, False
    return to, cut


NEXT, CUT = _machine()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that classes compose to, by number: of each class, the table of compositions, and the values from
    FRESH. Number 0 is the identity."""
    found = {tuple(range(8)): 0}
    todo = [*found]
    for f in todo:
        for row in NEXT.tolist():
            if (g := tuple(row[x] for x in f)) not in found:
                found[g] = len(found)
                todo.append(g)
    of = np.array([found[tuple(row)] for row in NEXT.tolist()])
    table = np.array([[found[tuple(g[x] for x in f)] for g in found] for f in found])
    return of, table, np.array([f[FRESH] for f in found], np.uint8)


OF_CLASS, COMPOSE, FROM_FRESH = _monoid()


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point; the last entry stands for the begin of a text."""
    white = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kind = {"L": L, "N": N}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(white)] = S
    return np.append(out, np.uint8(Z))


def _ending(points: np.ndarray, cls: np.ndarray) -> None:
    """Marks apostrophes that open 's 't 'm 'd (two code points) or 're 've 'll (three)."""
    at = np.flatnonzero(points == 0x27)
    pad = np.append(points, [0x110000] * 2)
    one, two = pad[at + 1], pad[at + 2]
    cls[at[np.isin(one, [ord(c) for c in "stmd"])]] = Q2
    cls[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = Q3


def begins(points: np.ndarray, width: int = 256) -> np.ndarray:
    """Where pieces begin. ``points``: code points, 0x110000 before each text."""
    cls = classes()[points]
    _ending(points, cls)
    follows = np.append(cls[1:], np.uint8(Z))
    lone = (cls == S) & (follows != S) & (follows != Z)
    cls[lone] = np.where(points[lone] == 0x20, SP, SX)
    n, rows = len(cls), -(-len(cls) // width)
    grid = np.full(rows * width, Z, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    then = np.ascontiguousarray(COMPOSE[:, OF_CLASS].astype(np.int32)).ravel()
    step = np.zeros(rows, np.int32)
    for column in grid:  # each block's function from the state before it to the state after it
        step = then[step * 9 + column]
    gap = 1
    while gap < rows:  # prefix scan of the blocks' functions by doubling
        step = np.concatenate([step[:gap], COMPOSE[step[:-gap], step[gap:]]])
        gap *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = FROM_FRESH[step[:-1]]
    flat, offset = NEXT.ravel(), np.arange(9, dtype=np.uint8) * 8
    out = np.empty((width, rows), bool)
    cut = CUT.ravel()
    for k, column in enumerate(grid):
        at = offset[column] + state
        out[k], state = cut[at], flat[at]
    return np.flatnonzero(out.T.ravel()[:n])


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Pairs(dict):
    """Rank of two ids joined, or a number above all; kept for the pairs seen, ``most`` of them at most."""

    def __init__(self, ranks: dict[bytes, int], names: list[bytes], most: int = 1 << 20):
        self.ranks, self.names, self.none, self.most = ranks, names, 1 << 30, most

    def __missing__(self, pair: int) -> int:
        if len(self) >= self.most:
            self.clear()
        self[pair] = out = self.ranks.get(self.names[pair >> 24] + self.names[pair & 0xFFFFFF], self.none)
        return out


def merge_short(ids: list[int], pairs: Pairs) -> list[int]:
    """As ``merge``, on plain lists of ids: faster for words."""
    near = [pairs[a << 24 | b] for a, b in zip(ids, ids[1:])]
    none = pairs.none
    while near and (least := min(near)) != none:
        i = near.index(least)
        ids[i] = least
        del ids[i + 1], near[i]
        if i < len(near):
            near[i] = pairs[least << 24 | ids[i + 1]]
        if i:
            near[i - 1] = pairs[ids[i - 1] << 24 | least]
    return ids


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank merges first, the leftmost of equals. n log n in its length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            ahead[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(parts[k])))
        if (h := ahead[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, len(parts[h]) + size))
    return [ranks[p] for p in parts if p is not None]


class Coder:
    """Encodes and decodes texts with one vocabulary; keeps the ids of pieces seen, ``most`` of them at most."""

    def __init__(self, raw: bytes, most: int = 300_000):
        self.ranks, self.most, self.seen, self.older = read_ranks(raw), most, {}, {}
        self.names = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.names[rank] = piece
        self.pairs = Pairs(self.ranks, self.names)
        self.of_byte = [self.ranks.get(bytes([b]), -1) for b in range(256)]

    def _new(self, piece: str) -> bytes:
        if len(piece) > 64:
            return np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if (ids := self.older.get(piece)) is None:
            raw = piece.encode()
            found = [whole] if (whole := self.ranks.get(raw)) is not None else merge_short([self.of_byte[b] for b in raw], self.pairs)
            ids = pack(f"<{len(found)}I", *found)
        if len(self.seen) >= self.most:  # two generations: what is still used outlives the change
            self.older.clear()
            self.older.update(self.seen)
            self.seen.clear()
        self.seen[piece] = ids
        return ids

    def encode(self, texts: list[str], most: int = 1 << 19) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids and the end of each piece in code points, both as little-endian unsigned 32-bit."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < most):
                size, j = size + len(texts[j]) + 1, j + 1
            run = texts[i:j]
            sizes = np.array([len(t) for t in run])
            heads = np.cumsum(sizes + 1) - sizes - 1
            points = np.empty(size, np.uint32)
            is_head = np.zeros(size, bool)
            is_head[heads] = True
            points[is_head] = 0x110000
            points[~is_head] = np.frombuffer("".join(run).encode("utf-32-le"), np.uint32)
            at = begins(points)
            firsts = np.searchsorted(at, heads)
            for text, head, a, b in zip(run, heads.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(at)]):
                cuts = at[a + 1 : b] - head - 1
                ends = np.append(cuts[1:], len(text)) if len(cuts) else cuts
                seen, get, new = self.seen, self.seen.get, self._new
                yield b"".join([get(p) or new(p) for p in [text[x:y] for x, y in zip(cuts.tolist(), ends.tolist())]]), ends.astype("<u4").tobytes()
            i = j

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), piece_ends (code points, the same form), decoded for every row.

    Null and empty texts have no ids; very long texts are encoded whole; repeated rows each get a row; a null doc_id stays null; an empty table gives no rows. ``vocabulary`` is the
    path of a rank file on the driver; its bytes (fixed, under 1 MB) are broadcast. Other columns are not read.
    """
    Scratch(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(ranks.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                ids, ends = map(list, zip(*coder.encode([t or "" for t in part.column(1).to_pylist()])))
                decoded = [coder.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in (ids, ends, decoded))], ["doc_id", "ids", "piece_ends", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, piece_ends binary, decoded binary")
