"""A compressed full-text index over words: wavelet matrix of the Burrows-Wheeler transform.

Rows are suffixes sorted by their first 16 symbols, which is enough for patterns of up to 15. The
transform is kept as one bit vector per bit of a symbol, packed in 64-bit words with a running count
per word; a rank query is one look-up and one bit count per level. All searches run side by side
for many patterns.
"""

from __future__ import annotations

import numpy as np

SORTED = 16


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of keys among the distinct keys, from 0."""
    order = np.argsort(key, kind="stable")
    held = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.concatenate([[False], held[1:] != held[:-1]]), dtype=np.int32)
    return rank


class FMIndex:
    """Over sequences of symbols 1 .. ``sigma`` - 1; 0 ends each sequence.

    ``depth``: the length of the windows searched for; ``value``: a number per sequence, of which
    the smallest over each interval is kept.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, value: np.ndarray, depth: int):
        """``text``: all sequences, each followed by 0; ``owner``: the sequence of each place."""
        if not 1 < depth < SORTED:
            raise ValueError(f"windows hold 2 to {SORTED - 1} symbols")
        self.depth, n = depth, len(text)
        after = lambda r, h: np.concatenate([r[h:] + 1, np.zeros(min(h, n), np.int32)])[:n]
        ranks, h = {1: text.astype(np.int32)}, 1
        while h < SORTED:
            two = after(ranks[h], h)
            ranks[2 * h] = _dense(ranks[h].astype(np.int64) * (int(two.max(initial=0)) + 1) + two)
            h *= 2
        self.rows = np.argsort(ranks[SORTED], kind="stable").astype(np.int32)

        def breaks(length: int) -> np.ndarray:
            """Where the first ``length`` symbols change from one row to the next."""
            out, at, h = np.zeros(n, bool), 0, SORTED
            out[:1] = True
            while at < length:
                while h > length - at:
                    h //= 2
                key = np.concatenate([ranks[h], np.full(SORTED, -1, np.int32)])[self.rows + at]
                out[1:] |= key[1:] != key[:-1]
                at += h
            return out

        start = np.flatnonzero(breaks(depth - 1))
        self.parent = np.cumsum(breaks(depth - 1), dtype=np.int32) - 1
        self.parent_lo, self.parent_hi = start, np.append(start[1:], n)
        full = breaks(depth)
        self.group = np.cumsum(full, dtype=np.int32) - 1
        self.least = np.minimum.reduceat(value[owner[self.rows]], np.flatnonzero(full)) if n else value[:0]
        sigma = int(text.max(initial=0)) + 1
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self._levels(text[self.rows - 1], sigma)

    def _levels(self, bwt: np.ndarray, sigma: int):
        n, self.bits = len(bwt), max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (bwt >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -n % 64, np.uint8)]), bitorder="little")
            words = packed.view(np.uint64)
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.first = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            word = at >> 6
            below = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ones[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of ``symbol`` followed by what [lo, hi) matches."""
        shift = self.count[symbol] - self.first[symbol]
        return self._descend(symbol, lo) + shift, self._descend(symbol, hi) + shift

    def windows(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns (one per row, ``depth`` symbols); empty where there is no match."""
        last = patterns[:, -1]
        lo, hi = self.count[last], self.count[last + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            lo, hi = self.extend(patterns[:, k], lo, hi)
        return lo, hi

    def slide(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a row of a window's interval to the window one to the left: its last symbol is
        dropped (the parent interval), ``symbol`` put in front."""
        p = self.parent[row]
        return self.extend(symbol, self.parent_lo[p], self.parent_hi[p])

    def least_of(self, text: np.ndarray, begin: np.ndarray, n_windows: np.ndarray) -> list[np.ndarray]:
        """Matching statistics at the threshold, for streamed sequences that the index holds: for
        each window of each sequence, right to left, the smallest value over its interval."""
        out = np.zeros(int(n_windows.sum()), np.int64)
        offset = np.cumsum(n_windows) - n_windows
        lanes = np.arange(len(begin))
        at = begin + n_windows - 1
        lo, _ = self.windows(text[at[:, None] + np.arange(self.depth)]) if len(begin) else (begin, begin)
        left = n_windows - 1
        out[offset + left] = self.least[self.group[lo]]
        while True:
            go = left > 0
            if not go.any():
                return np.split(out, offset[1:])
            lanes, lo, left, at = lanes[go], lo[go], left[go] - 1, at[go] - 1
            lo, _ = self.slide(text[at], lo)
            out[offset[lanes] + left] = self.least[self.group[lo]]
