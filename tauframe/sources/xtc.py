"""Compressed trajectory files (XTC) as coordinate rows.

A file is walked once by its frame headers, which only skips over the compressed payloads, and
cut into pieces of a few hundred frames. The pieces are spread over the cluster and decoded
there, so decoding a long trajectory is not one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tauframe.sources.readers import file_number

PIECE_FRAMES = 512         # a piece ends at this many frames
PIECE_BYTES = 4 << 20      # or this many bytes

# Fixed values of the public XTC format.
MAGIC = 1995
RAW_ATOMS = 9            # up to here coordinates are stored as plain floats
FIRST_STEP = 9           # first usable entry of STEPS
STEPS = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256,
    322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321,
    13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063,
    262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245,
    3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216]
HEAD = ">iiif9fi"      # magic, atoms, step, time, box, atoms again
PACKED = ">f3i3iii"    # precision, lowest, highest, step index, payload bytes


def frame_sizes(content: bytes) -> Iterator[int]:
    """Byte length of every frame, from headers alone."""
    at = 0
    while at < len(content):
        magic, atoms, *_, again = struct.unpack_from(HEAD, content, at)
        if magic != MAGIC or atoms != again:
            raise ValueError(f"not an XTC frame at byte {at}")
        if atoms <= RAW_ATOMS:
            size = struct.calcsize(HEAD) + 12 * atoms
        else:
            payload = struct.unpack_from(PACKED, content, at + struct.calcsize(HEAD))[-1]
            size = struct.calcsize(HEAD) + struct.calcsize(PACKED) + (payload + 3) // 4 * 4
        if at + size > len(content):
            raise ValueError("XTC file ends inside a frame")
        yield size
        at += size


class Bits:
    """Reads a byte string bit by bit, most significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, width: int) -> int:
        first, last = self.at >> 3, (self.at + width + 7) >> 3
        chunk = int.from_bytes(self.data[first:last], "big")
        chunk >>= (last << 3) - self.at - width
        self.at += width
        return chunk & ((1 << width) - 1)

    def triple(self, width: int, sizes) -> list[int]:
        """Three numbers mixed into one, stored as little-endian bytes."""
        value, shift = 0, 0
        while width > 0:
            step = min(8, width)
            value |= self.number(step) << shift
            shift, width = shift + 8, width - step
        value, third = divmod(value, sizes[2])
        return [*divmod(value, sizes[1]), third]


def decode_frame(content: bytes, at: int) -> tuple[float, np.ndarray]:
    """``(time, coordinates)`` of the frame that starts at byte ``at``; coordinates in nm."""
    head = struct.unpack_from(HEAD, content, at)
    atoms, time = head[1], head[3]
    at += struct.calcsize(HEAD)
    if atoms <= RAW_ATOMS:
        return time, np.frombuffer(content, ">f4", 3 * atoms, at).astype(float)
    precision, *corners, index, size = struct.unpack_from(PACKED, content, at)
    low, high = np.array(corners[:3]), np.array(corners[3:])
    sizes = [int(s) for s in high - low + 1]
    bits = Bits(content[at + struct.calcsize(PACKED):at + struct.calcsize(PACKED) + size])
    separate = max(sizes) > 0xFFFFFF
    width = 0 if separate else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    out = np.empty((atoms, 3), dtype=np.int64)
    done, run = 0, 0
    while done < atoms:
        if separate:
            whole = [bits.number(s.bit_length()) for s in sizes]
        else:
            whole = bits.triple(width, sizes)
        anchor = low + whole
        change = 0
        if bits.number(1):
            run, change = divmod(bits.number(5), 3)
            change -= 1
        out[done] = anchor
        first = done
        done += 1
        # a run holds small steps from the atom before; its first two atoms are stored swapped
        for k in range(run):
            small = np.array(bits.triple(index, [STEPS[index]] * 3)) - STEPS[index] // 2
            if k == 0:
                out[first], out[done] = anchor + small, anchor
            else:
                out[done] = before + small
            before = out[first] if k == 0 else out[done]
            done += 1
        index += change
    return time, (out / np.float32(precision)).reshape(-1)


def read_xtc(spark: SparkSession, path: str, pattern: str = "*.xtc",
             piece_frames: int = PIECE_FRAMES) -> DataFrame:
    """``(traj_id, frame, time, xyz ARRAY<DOUBLE>)``; trajectories are numbered by file name."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
             .select(file_number(F.col("path")).alias("traj_id"), "content"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for traj, content in zip(pdf["traj_id"], pdf["content"]):
                start, at, first, held = 0, 0, 0, 0
                for size in frame_sizes(content):
                    at, held = at + size, held + 1
                    if held == piece_frames or at - start >= PIECE_BYTES:
                        yield _piece(traj, first, content[start:at])
                        start, first, held = at, first + held, 0
                if held:
                    yield _piece(traj, first, content[start:at])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for traj, first, piece in zip(pdf["traj_id"], pdf["first"], pdf["piece"]):
                at, rows = 0, []
                for size in frame_sizes(piece):
                    rows.append(decode_frame(piece, at))
                    at += size
                yield pd.DataFrame({"traj_id": traj, "frame": np.arange(first, first + len(rows)),
                                    "time": [t for t, _ in rows], "xyz": [x for _, x in rows]})

    pieces = files.mapInPandas(cut, "traj_id bigint, first bigint, piece binary")
    return pieces.repartition("traj_id", "first").mapInPandas(
        decode, "traj_id bigint, frame bigint, time double, xyz array<double>")


def _piece(traj: int, first: int, content: bytes) -> pd.DataFrame:
    return pd.DataFrame({"traj_id": [traj], "first": [first], "piece": [content]})
