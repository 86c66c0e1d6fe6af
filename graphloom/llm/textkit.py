"""Vectorised text primitives on Arrow batches: words, hashes and windows without a Python loop per word."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, giving freed memory back at the end: worker processes outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone, whole."""
    _, at = raw(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of some texts in one pass: ``start``/``end`` byte positions, ``row`` of each and ``first[row]`` its first word."""

    def __init__(self, column: pa.Array | tuple[np.ndarray, np.ndarray], breaks: int | None = None):
        self.bytes, self.offsets = raw(column) if not isinstance(column, tuple) else column
        n = len(self.bytes)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~_SPACE[self.bytes]
        edge = np.zeros(n + 2, bool)
        edge[self.offsets + 1] = True
        self.start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[1:-1]))
        self.end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[2:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, read eight bytes at a time over all ranges at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    length = end - start
    h = mix(length.astype(np.uint64) + _M1)
    todo, k = np.arange(len(start)), 0
    while True:
        todo = todo[length[todo] > k] if k else todo[length > 0]
        if not len(todo):
            return h
        left = np.minimum(length[todo] - k, 8)
        x = np.ascontiguousarray(eight[start[todo] + k]).view(np.uint64)[:, 0] & _LOW[left]
        h[todo] = mix(h[todo] * _M1 ^ x)
        k += 8


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive items; the last n-1 starts have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = (out + h[k : k + m]) * _M1
        if k % 2:
            out ^= out >> np.uint64(32)
    return mix(out)


def within(row: np.ndarray, n: int) -> np.ndarray:
    """Which starts have all their ``n`` items in one row."""
    m = len(row) - n + 1
    return row[:m] == row[n - 1 :] if m > 0 else np.zeros(0, bool)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the least of each ``w`` consecutive values, by doubling."""
    m = len(x) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(x)), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(x[b] < x[a], b, a)
        span += step
    return best[:m]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def split_offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are byte ranges of ``data``; offsets count items of its type."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
