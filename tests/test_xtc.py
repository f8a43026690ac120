"""The trajectory decoder against an encoder written for these tests."""

import struct

import numpy as np
import pytest

from tauframe.sources import xtc


class Writer:
    def __init__(self):
        self.bits = []

    def number(self, value, width):
        self.bits += [(value >> (width - 1 - k)) & 1 for k in range(width)]

    def triple(self, values, width, sizes):
        mixed = (values[0] * sizes[1] + values[1]) * sizes[2] + values[2]
        while width > 0:
            step = min(8, width)
            self.number(mixed & 0xFF, step)
            mixed, width = mixed >> 8, width - step

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, padded[k:k + 8])), 2) for k in range(0, len(padded), 8))


def head(atoms, step, time):
    return struct.pack(">iiif9fi", 1995, atoms, step, time, *([0.0] * 9), atoms)


def encode(points, step=0, time=0.0, run=0, index=24, precision=1000.0, changes=()):
    """``run`` atoms after each whole atom are written as small steps; ``changes`` move the
    step index after the given groups."""
    atoms = len(points)
    if atoms <= 9:
        return head(atoms, step, time) + np.asarray(points, ">f4").tobytes()
    grid = np.rint(np.asarray(points) * precision).astype(int)
    low, high = grid.min(0), grid.max(0)
    sizes = [int(s) for s in high - low + 1]
    separate = max(sizes) > 0xFFFFFF
    out, at, told, group, start_index = Writer(), 0, 0, 0, index
    while at < atoms:
        here = min(run, atoms - at - 1)
        order = list(range(at, at + here + 1))
        if here:
            order[0], order[1] = order[1], order[0]     # the second atom of a run goes first
        value = [int(v) for v in grid[order[0]] - low]
        if separate:
            for v, s in zip(value, sizes):
                out.number(v, s.bit_length())
        else:
            out.triple(value, (sizes[0] * sizes[1] * sizes[2]).bit_length(), sizes)
        change = dict(changes).get(group, 0)
        if here != told or change:
            out.number(1, 1)
            out.number(here * 3 + change + 1, 5)
            told = here
        else:
            out.number(0, 1)
        base = grid[order[0]]
        for pos, atom in enumerate(order[1:]):
            size = xtc.STEPS[index]
            small = grid[atom] - base + size // 2
            assert (small >= 0).all() and (small < size).all()
            out.triple([int(v) for v in small], index, [size] * 3)
            base = grid[atom]
        index += change
        at, group = at + here + 1, group + 1
    data = out.bytes()
    body = struct.pack(">f3i3iii", precision, *low, *high, start_index, len(data))
    return head(atoms, step, time) + body + data + b"\0" * (-len(data) % 4)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(8)
    return np.cumsum(rng.uniform(-0.05, 0.05, (22, 3)), axis=0) + [1.5, 2.4, 1.4]


@pytest.mark.parametrize("run", [0, 1, 2, 5])
def test_decode(walk, run):
    time, xyz = xtc.decode_frame(encode(walk, time=2.5, run=run), 0)
    assert time == 2.5 and np.abs(xyz.reshape(-1, 3) - walk).max() <= 0.0005001


def test_changing_step_index(walk):
    data = encode(walk, run=2, index=26, changes=[(0, -1), (2, 1), (4, -1)])
    assert np.abs(xtc.decode_frame(data, 0)[1].reshape(-1, 3) - walk).max() <= 0.0005001


def test_wide_box(walk):
    far = walk * 1e5
    _, xyz = xtc.decode_frame(encode(far, precision=1000.0), 0)
    assert np.abs(xyz.reshape(-1, 3) - far).max() <= 0.01


def test_few_atoms_are_plain(walk):
    _, xyz = xtc.decode_frame(encode(walk[:9]), 0)
    assert np.allclose(xyz.reshape(-1, 3), walk[:9], atol=1e-6)


def test_steps_follow_the_cube_root_of_two():
    for k in range(xtc.FIRST_STEP, len(xtc.STEPS)):
        assert abs(xtc.STEPS[k] / 2 ** (k / 3) - 1) < 0.06


def test_files(spark, tmp_path, walk):
    for traj, frames in ((10, 23), (9, 4)):
        data = b"".join(encode(walk + f * 0.01, step=f, time=f * 0.1, run=f % 3) for f in range(frames))
        (tmp_path / f"traj{traj}.xtc").write_bytes(data)
    got = xtc.read_xtc(spark, str(tmp_path), piece_frames=5)
    rows = {(r.traj_id, r.frame): r for r in got.collect()}
    assert sorted(rows) == [(9, f) for f in range(4)] + [(10, f) for f in range(23)]
    r = rows[(10, 17)]
    assert r.time == pytest.approx(1.7)
    assert np.abs(np.array(r.xyz).reshape(-1, 3) - (walk + 0.17)).max() <= 0.0005001


def test_broken_files(walk):
    data = encode(walk)
    with pytest.raises(ValueError, match="not an XTC"):
        list(xtc.frame_sizes(b"\0" * 100))
    with pytest.raises(ValueError, match="ends inside"):
        list(xtc.frame_sizes(data[:-8]))
