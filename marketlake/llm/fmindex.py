"""An FM-index over word numbers: backward search on a wavelet tree of the Burrows-Wheeler transform.

Everything works on arrays of positions, so that all positions of a stream take a
step of the search together.  Bits are packed, 64 to a word with a running count,
so a text of n words over s different ones takes about n log2(s) bits instead of
64 n.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed vector of bits that counts the ones before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Numbers from 0 on, a vector of bits for each level, the highest bit first; zeros go left, ones right."""

    def __init__(self, values: np.ndarray) -> None:
        self.height = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for level in range(self.height - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            self.levels.append(Bits(ones))
            values = np.concatenate([values[~ones], values[ones]])

    def leaf(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` comes to lie among the rows of ``symbol`` in the last order; differences count its occurrences."""
        for level, bits in zip(range(self.height - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest number between the places ``low`` and ``high``, which differ."""
        value = np.zeros(len(low), np.int64)
        for level, bits in zip(range(self.height - 1, -1, -1), self.levels, strict=True):
            first, last = bits.rank(low), bits.rank(high)
            left = high - low > last - first
            low, high = np.where(left, low - first, bits.zeros + first), np.where(left, high - last, bits.zeros + last)
            value |= np.where(left, 0, 1 << level)
        return value


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes by their first ``depth`` symbols, by prefix doubling."""
    rank, reach = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - reach] = rank[reach:] + 1
        rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Of texts laid end to end, each followed by a 0; word numbers are from 1 on.  Finds up to ``depth`` words at once.

    ``owner`` has a number for each position; the least of all places where a match starts can be asked for.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, depth: int) -> None:
        order = suffix_order(symbols, depth)
        self.size = len(symbols)
        self.starts = np.zeros(int(symbols.max(initial=0)) + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=len(self.starts) - 1), out=self.starts[1:])
        self.tree = WaveletTree(symbols[order - 1])
        every = np.arange(len(self.starts) - 1)
        #: of each symbol, what turns a leaf's place into a row
        self.shift = self.starts[:-1] - self.tree.leaf(every, np.zeros(len(every), np.int64))
        self.owners = WaveletTree(owner[order])

    def statistics(self, stream: np.ndarray, most: int, rows: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every place of ``stream``: how many words up to and with it, ``most`` at most, occur together in at least ``rows`` rows, and those rows.

        A 0 ends a text; numbers that the index doesn't have match nothing.
        """
        known = len(self.shift)
        length = np.zeros(len(stream), np.int64)
        low, high = np.zeros(len(stream), np.int64), np.full(len(stream), self.size, np.int64)
        going = np.arange(len(stream))
        for step in range(most):
            at = going - step
            going, at = going[at >= 0], at[at >= 0]
            symbol = stream[at]
            real = (symbol > 0) & (symbol < known)
            going, symbol = going[real], symbol[real]
            if not len(going):
                break
            if step:
                ends = self.tree.leaf(np.tile(symbol, 2), np.concatenate([low[going], high[going]]))
                first, last = ends[: len(going)] + self.shift[symbol], ends[len(going) :] + self.shift[symbol]
            else:
                first, last = self.starts[symbol], self.starts[symbol + 1]
            enough = last - first >= rows
            going = going[enough]
            low[going], high[going] = first[enough], last[enough]
            length[going] += 1
        return length, low, high
