"""Lagged pairs inside a task, for Arrow passes over rows sorted by (chunk, frame).

A task holds one Arrow batch plus at most ``horizon`` earlier rows at a time, so its memory
does not depend on the length of a trajectory or the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def encode(column: pa.ChunkedArray) -> pa.DictionaryArray:
    """Dictionary form of a column as one array."""
    out = column.combine_chunks().dictionary_encode()
    return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


def run_ids(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Number the runs of equal values in the named (sorted) columns."""
    change = np.zeros(table.num_rows, dtype=bool)
    for name in names:
        idx = encode(table[name]).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= idx[1:] != idx[:-1]
    return np.cumsum(change)


@dataclass
class Block:
    """Rows of one or more chunks; ``ready`` marks origins whose horizon is all here."""

    table: pa.Table
    run: np.ndarray
    frame: np.ndarray
    ready: np.ndarray

    def __post_init__(self):
        step = np.diff(self.frame) == 1
        self.gapless = bool(np.all(step | (self.run[1:] != self.run[:-1])))
        self.origins = np.flatnonzero(self.ready)

    def pairs(self, tau: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (now, later) of all pairs ``tau`` frames apart with a ready origin."""
        src, size = self.origins, len(self.frame)
        if self.gapless:
            src = src[src + tau < size]
            dst = src + tau
            same = self.run[src] == self.run[dst]
        else:
            stride = int(self.frame.max() - self.frame.min()) + tau + 1
            place = self.run * stride + (self.frame - self.frame.min())
            dst = np.searchsorted(place, place[src] + tau)
            src, dst = src[dst < size], dst[dst < size]
            same = place[dst] == place[src] + tau
        return src[same], dst[same]


def sorted_blocks(batches: Iterator[pa.RecordBatch], part: Sequence[str],
                  horizon: int) -> Iterator[Block]:
    """Blocks in which every origin appears as ready exactly once. Rows carry ``frame`` and
    ``_own`` (false for halo copies, which are partners but never origins)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if held is not None and held.num_rows:
            table = pa.concat_tables([held, table]).combine_chunks()
        run, frame, own = _columns(table, part)
        waiting = (run == run[-1]) & (frame + horizon > frame[-1])
        yield Block(table, run, frame, own & ~waiting)
        held = table.filter(pa.array(waiting))
    if held is not None and held.num_rows:
        run, frame, own = _columns(held, part)
        yield Block(held, run, frame, own)


def _columns(table: pa.Table, part: Sequence[str]):
    return (run_ids(table, part), table["frame"].to_numpy(),
            table["_own"].to_numpy(zero_copy_only=False))
