"""Word hashing over Arrow batches of UTF-8 text with NumPy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240101)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random odd number for each byte, 0 for white space; A-Z hash as a-z.
BYTE = (_rng.integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
BYTE = BYTE[LOWER]
BYTE[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 4096), _STEP, np.uint64), dtype=np.uint64)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for runs of rows of about ``most`` bytes."""
    raw, at = utf8(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word, and for every row the index of its first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    gap = SPACE[raw]
    edge = np.ones(len(raw) + 1, bool)  # a word can begin here
    edge[1:-1] = gap[:-1]
    edge[at] = True
    first = edge[:-1] & ~gap
    starts = np.flatnonzero(first)
    last = np.ones(len(raw), bool)
    last[:-1] = gap[1:]
    last[at[1:-1][at[1:-1] > 0] - 1] = True
    ends = np.flatnonzero(last & ~gap) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    place = np.arange(len(raw)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    longest = int((ends - starts).max())
    np.clip(place, 0, longest - 1, out=place)  # only white space lies beyond
    hashes = mix64(np.add.reduceat(BYTE[raw] * powers(longest)[place], starts))
    return starts, ends, hashes, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix64(out * _STEP + hashes[k : k + n])
    return out
