"""Words of whole texts as numpy arrays of hashes, inside Arrow tasks.

Words are runs of bytes other than ASCII white space. A slice of texts is one byte buffer; words,
their hashes and the hashes of word sequences are found for the whole slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_500_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RADIX = 0x9E3779B97F4A7C15
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
#: Odd multipliers, one per word of a sequence, from a fixed rule.
ODD = np.array([(0xD6E8FEB86659FD93 * (2 * k + 1) ^ (k << 40)) & (2**64 - 1) | 1 for k in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_RADIX, pow(_RADIX, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


@dataclass
class Words:
    """Words of a slice: byte places in ``buffer``, hashes, and each text's first word."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than texts

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes_of(self, lo: int, hi: int) -> bytes:
        """The bytes from word ``lo`` up to the end of word ``hi - 1``."""
        return self.buffer[self.start[lo]:self.end[hi - 1]].tobytes() if hi > lo else b""


def words_of(texts: list[bytes], change: np.ndarray | None = None, hashed: bool = True) -> Words:
    """``change``: a table of 256 bytes applied to all bytes first."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if change is not None:
        buffer = change[buffer]
    space = _SPACE[buffer]
    turn = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    h = np.zeros(len(start), np.uint64)
    lo = 0
    while hashed and lo < len(start):  # in pieces that stay in cache
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + 250_000)))
        at = start[lo]
        part = buffer[at:end[hi - 1]]
        power, inverse = _powers(max(len(part), 300_000))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=total[1:])
        s, e = start[lo:hi] - at, end[lo:hi] - at
        h[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return Words(buffer, start, end, h, first)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive words, for each place that has them (also across texts)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * ODD[0]
    for k in range(1, n):
        out += h[k:k + m] * ODD[k]
    return mix(out)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of batches of about ``size`` bytes of text, with the texts as UTF-8 (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo, held = 0, 0
        for k, s in enumerate(sizes):
            held += s
            if held >= size or k == len(sizes) - 1:
                part = batch.slice(lo, k + 1 - lo)
                yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
                lo, held = k + 1, 0
        pa.default_memory_pool().release_unused()  # workers outlive their tasks
