"""A compressed FM-index over word numbers, with vectorised backward search.

The text is a sequence of numbers; 0 ends each piece and only there. What is kept of it is its
Burrows-Wheeler transform as a wavelet matrix (a wavelet tree stored level by level), how often
each number occurs, and one bit a row for the parent step: about one and a half bits a symbol and
level. Text and suffix order are dropped once these are built, so the index says whether and how
often a pattern occurs, not where. Bit vectors are packed 64 to a word with a running count per
word, so rank costs one lookup and one population count. All patterns of a batch advance together.

Suffixes are ordered by their first ``depth`` symbols, ties by place. That is enough for patterns
of up to ``depth`` symbols: rows that begin with a shorter pattern stand together, and a symbol's
occurrences before them count the rows of the longer pattern's smaller neighbours.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank, and select by search over the counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, counted from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (word << 6) + (np.cumsum(bits, 1, dtype=np.int8) > (k - self.before[word])[:, None]).argmax(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        now = symbols
        for level in reversed(range(self.depth)):
            bit = (now >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        lo, hi = np.zeros_like(at), at
        for level, bits, zeros in zip(reversed(range(self.depth)), self.levels, self.zeros):
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


def _ranks(rank: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by a rank and by the rank ``shift`` further on, and the new rank."""
    n = len(rank)
    second = np.zeros(n, np.int64)
    second[: max(0, n - shift)] = rank[shift:]
    key = rank * (n + 2) + second
    order = np.argsort(key, kind="stable")
    new = np.ones(n, np.int64)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new)
    return order, out


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` symbols, by prefix doubling, and which rows differ from the
    row before them within the first ``depth`` - 1."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while 2 * span <= depth - 1:
        rank, span = _ranks(rank, span)[1], 2 * span
    # two overlapping spans cover what is left, so equal pairs of ranks are equal prefixes
    shorter = _ranks(rank, depth - 1 - span)[1] if depth > 1 else np.ones(len(text), np.int64)
    order, _ = _ranks(shorter, 1) if depth > 1 else _ranks(rank, len(rank))
    starts = np.ones(len(text), bool)
    starts[1:] = shorter[order][1:] != shorter[order][:-1]
    return order, starts


class FMIndex:
    """``text`` holds numbers 0..sigma-1; 0 ends each piece. For patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        order, starts = suffix_order(text, depth)
        self.n, self.sigma, self.depth = len(text), sigma, depth
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.parents = Bits(starts)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``symbol`` followed by what the rows stand for: one step of backward search."""
        both = self.bwt.occurrences(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.starts[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parent step: rows that share all but the last of the ``depth`` symbols of row ``lo``."""
        group = self.parents.rank(lo + 1) - 1
        last = group + 1 >= self.parents.ones
        return self.parents.select(group), np.where(last, self.n, self.parents.select(np.where(last, group, group + 1)))

    def statistics(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed pieces, as far as ``depth``: (piece, offset, occurrences) of the places
        whose next ``depth`` symbols occur in the index.

        Pieces (``size`` symbols from ``first``; a negative symbol is one that the index does not hold) go through
        it at once, from their ends to their beginnings. Behind a place that matched to the full depth, the parent
        step drops the last symbol and one backward step takes the next; behind one that did not, the pattern is
        searched anew, symbol by symbol, until no row is left."""
        depth, m = self.depth, len(first)
        unknown = np.concatenate([[0], np.cumsum(text < 0)])
        lo, hi, known = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
        out: list[tuple] = []
        for back in range(int((size - depth).max(initial=-1)) + 1):
            lane = np.flatnonzero(size - depth >= back)
            at = first[lane] + size[lane] - depth - back
            able = unknown[at + depth] == unknown[at]
            known[lane[~able]] = False
            lane, at = lane[able], at[able]
            go = known[lane]
            step = lane[go]
            if len(step):
                a, b = self.shorten(lo[step])
                lo[step], hi[step] = self.extend(text[at[go]], a, b)
            who, place = lane[~go], at[~go]
            if len(who):
                a, b = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
                live = np.arange(len(who))
                for k in reversed(range(depth)):
                    a[live], b[live] = self.extend(text[place[live] + k], a[live], b[live])
                    live = live[a[live] < b[live]]
                    if not len(live):
                        break
                lo[who], hi[who] = a, b
            known[lane] = lo[lane] < hi[lane]
            hit = lane[known[lane]]
            out.append((hit, size[hit] - depth - back, hi[hit] - lo[hit]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))
