"""An FM-index over integer sequences in numpy: suffix order, wavelet tree, backward search, locating."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by prefix doubling. The sequence must end in a value found nowhere else."""
    n, k = len(text), 1
    _, rank = np.unique(text, return_inverse=True)
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Bits:
    """A bit vector with ranks: counts at every 64 bits and population counts within."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate((bits, np.zeros(64 - len(bits) % 64, bool))), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place of i."""
        word, off = i >> 6, (i & 63).astype(np.uint64)
        part = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << off) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part).astype(np.int64)


class Wavelet:
    """Wavelet tree (levels as one bit vector each, zeros before ones) with rank of a symbol before a place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[Bits, int]] = []
        self.height = max(1, int(sigma - 1).bit_length())
        for level in range(self.height - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for level, (bits, zeros) in zip(range(self.height - 1, -1, -1), self.levels, strict=True):
            a, b = bits.ones(lo), bits.ones(hi)
            one = (symbol >> level & 1).astype(bool)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, (bits, zeros) in zip(range(self.height - 1, -1, -1), self.levels, strict=True):
            a = bits.ones(i)
            one = bits.ones(i + 1) > a
            out |= one.astype(np.int64) << level
            i = np.where(one, zeros + a, i - a)
        return out


class FMIndex:
    """Index of runs of symbols 1..sigma-1, laid end to end, each followed by a separator.

    Suffixes are told apart within a run (separators differ in the order), so the order takes
    as many doublings as the longest run has binary digits. Places are sampled at run starts
    and every SAMPLE places, so that locating never steps over a separator.
    """

    def __init__(self, text: np.ndarray, sigma: int):
        """text: symbols, 0 where a separator stands; ends in one."""
        gap = text == 0
        told = text + gap.sum() - 1
        told[gap] = np.arange(gap.sum())
        order = suffix_order(told)
        self.bwt = Wavelet(text[order - 1], sigma)
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        first = np.concatenate(([True], gap[:-1]))
        kept = first[order] | (order % SAMPLE == 0)
        self.kept, self.places, self.n = Bits(kept), order[kept], len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (rows of equal length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for column in patterns.T[::-1]:
            c = column[alive]
            a = self.first[c] + self.bwt.rank(c, lo[alive])
            b = self.first[c] + self.bwt.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[a < b]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by their rank."""
        out, steps, todo, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            before = self.kept.ones(at)
            hit = self.kept.ones(at + 1) > before
            out[todo[hit]] = self.places[before[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt.access(at)
            at = self.first[c] + self.bwt.rank(c, at)
            steps += 1
        return out
