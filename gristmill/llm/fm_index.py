"""A compressed FM-index over word sequences, with matching statistics for many streams at once.

The Burrows-Wheeler transform of a shard's sequences is held as a wavelet matrix: one bit vector for each bit
of the word numbers, packed 64 to a machine word, with a directory of counts. Backward search extends a
pattern to the left by two rank queries a level. Only patterns up to a fixed depth matter, so suffixes are
sorted to that depth, by doubling, and the suffix array itself is not kept.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each machine word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence of symbols below ``sigma``."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[BitVector] = []
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append(BitVector(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = self._walk(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, vector in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = vector.rank(i)
            i = np.where(symbol >> level & 1, vector.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i."""
        return self._walk(symbol, i) - self.begin[symbol]


class FMIndex:
    """Index of sequences (values above 0, concatenated, each with an owner) for patterns up to ``depth`` words."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, owners: np.ndarray, depth: int):
        n_seq, sizes = len(offsets) - 1, np.diff(offsets)
        text = np.zeros(len(values) + n_seq, dtype=np.int64)  # a 0 ends each sequence
        text[np.arange(len(values)) + np.repeat(np.arange(n_seq), sizes)] = values
        n = len(text)
        self.depth, self.sigma = depth, int(values.max()) + 1 if len(values) else 1
        rank, step = text.copy(), 1
        order = np.argsort(rank, kind="stable")
        while step < depth:
            further = np.zeros(n, dtype=np.int64)
            further[: n - step] = rank[step:] + 1
            # a sequence end stops the comparison: what follows it does not count
            key = rank * (n + self.sigma + 2) + np.where(text == 0, 0, further)
            order = np.argsort(key, kind="stable")
            fresh = np.ones(n, dtype=np.int64)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(fresh) - 1
            step *= 2
            if step < depth:
                rank[text == 0] = 0  # zeros sort first and stay equal
        self.size = n
        self.before = np.searchsorted(np.sort(text), np.arange(self.sigma))
        self.bwt = WaveletMatrix(text[order - 1], self.sigma)
        # common prefixes of neighbours, up to the depth and never across an end
        self.common = np.zeros(n, dtype=np.uint8)
        alike = np.ones(n - 1, dtype=bool)
        for k in range(depth):
            left, right = np.minimum(order[:-1] + k, n - 1), np.minimum(order[1:] + k, n - 1)
            alike &= (text[left] == text[right]) & (text[left] != 0)
            if not alike.any():
                break
            self.common[1:] += alike
        owner = np.repeat(owners, sizes + 1)[order]
        self._breaks: dict[int, np.ndarray] = {}
        self.least = np.minimum.reduceat(owner, self.breaks(depth)) if n else owner

    def breaks(self, depth: int) -> np.ndarray:
        """First rows of the classes of suffixes that agree in ``depth`` words."""
        if depth not in self._breaks:
            self._breaks[depth] = np.flatnonzero(self.common < depth)
        return self._breaks[depth]

    def shorten(self, low: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that agree with row ``low`` in ``depth`` words."""
        cuts = self.breaks(depth)
        k = np.searchsorted(cuts, low, side="right")
        return cuts[k - 1], np.append(cuts, self.size)[k]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pattern with one more word in front: a step of backward search."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def matching_statistics(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each stream: the longest match that starts there, up to the depth, and the least
        owner of the sequences with a match of the full depth (else the largest integer).

        Values that the index does not hold are 0. Streams run from right to left, all in step.
        """
        sizes = np.diff(offsets)
        streams = np.argsort(-sizes, kind="stable")
        ends = offsets[1:][streams]
        length = np.zeros(len(values), dtype=np.int64)
        owner = np.full(len(values), np.iinfo(np.int64).max)
        low, high = np.zeros(len(streams), dtype=np.int64), np.full(len(streams), self.size, dtype=np.int64)
        have = np.zeros(len(streams), dtype=np.int64)
        live = np.searchsorted(-sizes[streams], -np.arange(1, sizes.max(initial=0) + 1), side="right")
        for step, n in enumerate(live):
            place = ends[:n] - 1 - step
            word = values[place]
            full = np.flatnonzero(have[:n] == self.depth)
            if len(full):
                low[full], high[full] = self.shorten(low[full], self.depth - 1)
                have[full] -= 1
            todo = np.arange(n)
            while len(todo):
                a, b = self.extend(word[todo], low[todo], high[todo])
                found = (a < b) & (word[todo] != 0)
                done = todo[found]
                low[done], high[done] = a[found], b[found]
                have[done] += 1
                todo = todo[~found]
                lost = todo[have[todo] == 0]  # not even one word matches
                low[lost], high[lost] = 0, self.size
                todo = todo[have[todo] > 0]
                for d in np.unique(have[todo]):
                    some = todo[have[todo] == d]
                    if d == 1:
                        low[some], high[some] = 0, self.size
                    else:
                        low[some], high[some] = self.shorten(low[some], int(d) - 1)
                    have[some] = d - 1
            length[place] = have[:n]
            whole = np.flatnonzero(have[:n] == self.depth)
            if len(whole):
                owner[place[whole]] = self.least[np.searchsorted(self.breaks(self.depth), low[whole], side="right") - 1]
        return length, owner
