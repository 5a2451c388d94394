"""A compressed full-text index of word sequences: suffix order, BWT in a wavelet tree, backward search.

Everything works on whole numpy arrays: a search extends all its patterns by one word at a time, so a step costs a few
array operations per level of the tree, however many patterns there are.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 64


class Bits:
    """A bit vector with counts of ones: one sum per 64 bits."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros(-(-(len(flags) + 1) // _BLOCK) * _BLOCK, dtype=np.uint8)
        padded[:len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        rest = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(rest)


class WaveletTree:
    """Counts of a symbol before a place, by one bit vector per bit of the symbols (the highest first)."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            flags = ((symbols >> level) & 1).astype(bool)
            self.levels.append(Bits(flags))
            self.zeros.append(int(len(flags) - flags.sum()))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])
        #: Where the places of each symbol begin below the last level.
        self.begins = self._down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            up = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            ones = level.ones(at)
            at = np.where(up, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.begins[symbol]


class Index:
    """Index of several sequences of 64-bit words, each with a value; finds the least value among a pattern's places.

    ``depth`` is the longest pattern: suffixes are ordered by so many words only. A sequence ends with a mark that no
    pattern holds.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, values: np.ndarray, depth: int):
        self.depth = depth
        self.alphabet, codes = np.unique(words, return_inverse=True)
        lengths = np.diff(first)
        # Symbols from 1; 0 ends each sequence.
        size = len(words) + len(lengths)
        text = np.zeros(size, dtype=np.int64)
        places = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        text[places] = codes + 1
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        order, ranks = self._sorted(text, depth)
        self.bwt = WaveletTree(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 2))])
        self.size = size
        self._outer = self._runs(ranks, order, depth - 1)
        self._least = self._sparse(values[owner[order]])

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Suffixes in the order of their first ``depth`` symbols or more, by doubling, and their ranks by the first 1, 2, 4, ... symbols.

        The text is taken as a circle; its symbols are at most its length.
        """
        ranks, width, bits = {1: text}, 1, len(text).bit_length()
        while True:
            pair = ranks[width] * (len(text) + 1) + np.roll(ranks[width], -width)
            if 3 * bits < 64:  # pair and place fit in one number, which sorts without an index
                pair = np.sort((pair << bits) | np.arange(len(text)))
                order, pair = pair & ((1 << bits) - 1), pair >> bits
            else:
                order = np.argsort(pair, kind="stable")
                pair = pair[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = pair[1:] != pair[:-1]
            width *= 2
            ranks[width] = np.empty(len(text), dtype=np.int64)
            ranks[width][order] = np.cumsum(new) - 1
            # One symbol more than a pattern has: the order of a suffix behind its first word must be known, too.
            if width > depth or new.all():
                return order, ranks

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        """Minima of all runs of 1, 2, 4, ... values."""
        out, span = [values], 1
        while 2 * span <= len(values):
            out.append(np.minimum(out[-1][:-span], out[-1][span:]))
            span *= 2
        return out

    @staticmethod
    def _runs(ranks: dict[int, np.ndarray], order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the run of suffixes around each one that agree in their first ``depth`` symbols."""
        new = np.zeros(len(order), dtype=bool)
        new[0] = True
        at = 0
        while at < depth:
            width = max(w for w in ranks if w <= depth - at)
            part = ranks[width][(order + at) % len(order)]
            new[1:] |= part[1:] != part[:-1]
            at += width
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        return starts[of], np.append(starts[1:], len(order))[of]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of each nonempty interval of the suffix order."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=self._least[0].dtype)
        for i in np.unique(level):
            at = np.flatnonzero(level == i)
            out[at] = np.minimum(self._least[i][low[at]], self._least[i][high[at] - (1 << int(i))])
        return out

    def search(self, words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of the patterns words[at : at + length], by backward search; low = high if absent."""
        codes = np.searchsorted(self.alphabet, words)
        known = codes < len(self.alphabet)
        known[known] = self.alphabet[codes[known]] == words[known]
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.size, dtype=np.int64)
        for step in range(length - 1, -1, -1):
            symbol = np.where(known[at + step], codes[at + step] + 1, 0)
            alive = known[at + step] & (high > low)
            start = self.starts[symbol]
            low = np.where(alive, start + self.bwt.rank(symbol, low), 0)
            high = np.where(alive, start + self.bwt.rank(symbol, high), 0)
        return low, high

    def matches(self, words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``search`` for rising ``at``, with length = depth: matching statistics cut at the depth.

        Of consecutive places only the last is searched in full. From a place to the one before it the interval is
        widened to the pattern's first depth - 1 words and narrowed by one word in front; all runs of places go one step
        at a time together. Where a pattern is absent, the rest of its run is searched in full.
        """
        low, high = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        if not len(at):
            return low, high
        ends = np.append(np.flatnonzero(np.diff(at) != 1), len(at) - 1)
        begins = np.append(0, ends[:-1] + 1)
        low[ends], high[ends] = self.search(words, at[ends], length)
        codes = np.searchsorted(self.alphabet, words)
        known = codes < len(self.alphabet)
        known[known] = self.alphabet[codes[known]] == words[known]
        now, left = ends, begins
        lost = []
        while len(now):
            present = high[now] > low[now]
            lost += [np.arange(a, b) for a, b in zip(left[~present], now[~present])]
            more = present & (now > left)
            now, left = now[more], left[more]
            outer_low, outer_high = (o[low[now]] for o in self._outer)
            now = now - 1
            symbol = np.where(known[at[now]], codes[at[now]] + 1, 0)
            start = self.starts[symbol]
            found_low, found_high = start + self.bwt.rank(symbol, outer_low), start + self.bwt.rank(symbol, outer_high)
            good = known[at[now]] & (found_high > found_low)
            low[now], high[now] = np.where(good, found_low, 0), np.where(good, found_high, 0)
        if lost:
            rest = np.concatenate(lost)
            low[rest], high[rest] = self.search(words, at[rest], length)
        return low, high
