"""Compressed FM-index over sequences of small integers: wavelet matrix, packed bits, ranks."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bit vector with a running count per 64 bits; ``rank(i)`` ones lie before place i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        ones = np.bitwise_count(words)
        self.before = np.concatenate(([0], np.cumsum(ones[:-1], dtype=np.int64))).astype(np.uint32)
        self.total = int(ones.sum(dtype=np.int64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at].astype(np.int64) + np.bitwise_count(self.words[at] & below)


class Wavelets:
    """Wavelet matrix: one bit vector per binary digit of the symbols, the highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for digit in reversed(range(max(1, int(size - 1).bit_length()))):
            one = (symbols >> digit & 1).astype(bool)
            self.levels.append((digit, Bits(one), int((~one).sum())))
            symbols = np.concatenate((symbols[~one], symbols[one]))

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ``symbol`` before ``lo`` and before ``hi``, given its first place at 0."""
        start = np.zeros_like(lo)
        for digit, bits, zeros in self.levels:
            one = (symbol >> digit & 1).astype(bool)
            three = bits.rank(np.concatenate((start, lo, hi))).reshape(3, -1)
            start, lo, hi = (np.where(one, zeros + r, i - r) for r, i in zip(three, (start, lo, hi)))
        return lo - start, hi - start


def _ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of integers, the first key the most important."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class FMIndex:
    """Index of ``text`` (symbols from 1; 0 ends a sequence, the last one too) for patterns of up
    to ``width`` symbols: suffixes are sorted by their first ``width`` symbols."""

    def __init__(self, text: np.ndarray, width: int):
        text = np.asarray(text, dtype=np.int64)
        n, self.width = len(text), width
        if n and text[-1]:
            raise ValueError("the last sequence has no end")
        ranks, done = {1: _ranked(text)}, 1
        shifted = lambda r, by: np.concatenate((r[by:] + 1, np.zeros(min(by, len(r)), dtype=np.int64)))
        while 2 * done <= width:
            ranks[2 * done] = _ranked(ranks[done], shifted(ranks[done], done))
            done *= 2

        def prefix(k: int) -> np.ndarray:  # ranks by the first k symbols, done <= k <= 2 * done or k < done
            p = done
            while p > k:
                p //= 2
            return ranks[p] if p == k else _ranked(ranks[p], shifted(ranks[p], k - p))

        by_width = prefix(width)
        suffix = np.argsort(by_width, kind="stable")
        self.size = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.size))))
        self.bwt = Wavelets(text[suffix - 1], self.size)
        parent = (prefix(width - 1) if width > 1 else np.zeros(n, dtype=np.int64))[suffix]
        heads = np.concatenate(([True], parent[1:] != parent[:-1])) if n else np.zeros(0, dtype=bool)
        self.blocks, self.block_starts = Bits(heads), np.append(np.flatnonzero(heads), n)
        self.n = n

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes for ``symbol`` put before the patterns of [lo, hi)."""
        a, b = self.bwt.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def parents(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first width - 1 symbols of the suffixes at ``lo``."""
        block = self.blocks.rank(lo + 1) - 1
        return self.block_starts[block], self.block_starts[block + 1]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns, the rows of a matrix of at most ``width`` columns; empty where a
        pattern doesn't occur.  Symbols of 1 and more that the text lacks are allowed."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for k in reversed(range(patterns.shape[1])):
            known = patterns[:, k] < self.size
            lo, hi = self.step(np.where(known, patterns[:, k], 0), lo, hi)
            hi = np.where(known, hi, lo)
        return lo, hi

    def matching_statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Streams sequences text[starts:starts + lengths] through the index, from their ends, all
        at a time: (sequence, place, lo, hi) of every window of ``width`` symbols that the index
        has.  A window that it lacks ends a match; the windows left of it begin anew from their
        own last symbols, so a long foreign sequence costs ``width`` steps a window.
        """
        width, out = self.width, []
        at = starts + lengths - width  # place of the next window
        live = np.flatnonzero(lengths >= width)
        at, fresh = at[live], np.ones(len(live), dtype=bool)
        lo, hi = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        while len(live):
            some = np.flatnonzero(fresh)
            if len(some):
                lo[some], hi[some] = self.search(text[at[some][:, None] + np.arange(1, width)])
            lo, hi = self.step(np.minimum(text[at], self.size - 1), lo, hi)
            hit = (lo < hi) & (text[at] < self.size)
            out.append((live[hit], at[hit] - starts[live[hit]], lo[hit], hi[hit]))
            fresh = ~hit
            if hit.any():
                lo[hit], hi[hit] = self.parents(lo[hit])
            at = at - 1
            more = at >= starts[live]
            live, at, fresh, lo, hi = live[more], at[more], fresh[more], lo[more], hi[more]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
