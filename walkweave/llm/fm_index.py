"""An FM-index over integer symbols: backward search (Ferragina and Manzini 2000) over a wavelet matrix (Claude and Navarro 2012), in numpy."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector, 64 bits to a word, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """A sequence of numbers below 2^levels, one bit vector per level, the highest bit first."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels = []
        for level in range(levels - 1, -1, -1):
            bits = ((values >> level) & 1).astype(np.uint8)
            self.levels.append((level, Bits(bits)))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places before start and before end among the symbol's own, both shifted by where these stand on the last level; their difference counts."""
        for level, bits in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.ones(start), bits.ones(end)
            start, end = np.where(one, bits.zeros + a, start - a), np.where(one, bits.zeros + b, end - b)
        return start, end


class FMIndex:
    """text: symbols from 1 up, 0 between its parts. Suffixes are sorted by their first `depth` symbols at least, so patterns shorter than that are found exactly."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, reach = text.astype(np.int64), 1
        while reach < depth:
            second = np.zeros(n, np.int64)
            second[: max(n - reach, 0)] = rank[reach:] + 1
            _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + second, return_inverse=True)
            reach *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        last = text[self.suffixes - 1]  # what stands before each suffix; before the first, the text's last symbol
        self.top = int(text.max(initial=0))
        self.matrix = WaveletMatrix(last.astype(np.int64), max(self.top.bit_length(), 1))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        # Where a symbol's own stand on the matrix's last level.
        symbols = np.arange(self.top + 1)
        self.base = self.matrix.rank(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))[0]

    def extend(self, symbol: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with symbol and then what the interval's suffixes begin with."""
        a, b = self.matrix.rank(symbol, start, end)
        return self.first[symbol] + a - self.base[symbol], self.first[symbol] + b - self.base[symbol]

    def match(self, text: np.ndarray, ends: np.ndarray, most: int, at_least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a text that is streamed through the index: for each end (not included), the length up to `most` of the longest match that ends there
        and stands at least `at_least` times in the index, and for those of full length the interval of its suffixes (0, 0 otherwise)."""
        length = np.zeros(len(ends), np.int64)
        start, end = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes), np.int64)
        live = np.arange(len(ends))
        for step in range(1, most + 1):
            live = live[ends[live] >= step]
            a, b = self.extend(text[ends[live] - step], start[live], end[live])
            found = (b - a >= at_least) & (text[ends[live] - step] > 0)
            live = live[found]
            start[live], end[live], length[live] = a[found], b[found], step
        full = length == most
        return length, np.where(full, start, 0), np.where(full, end, 0)
