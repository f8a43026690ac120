"""Lagged second moments of feature trajectories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tauframe.functions.arrays import matrix_of
from tauframe.operators.blocks import sorted_blocks
from tauframe.operators.grouped import per_model
from tauframe.operators.sequences import CHUNK_ROWS, check_lags, with_halo


FAN = 64    # merged partial results per step
PARTIAL = "lag int, n bigint, mx array<double>, my array<double>, same array<double>, cross array<double>"


@dataclass
class Partial:
    """Centred moments of some pairs (x, y): means, sums of products of deviations from them.

    ``same`` is over x and over y added up, ``cross`` over x and y. Two partials add up exactly
    (Chan, Golub, LeVeque, Am. Stat. 37, 242, 1983), so means of any size cost no digits."""

    n: int
    mx: np.ndarray
    my: np.ndarray
    same: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> "Partial":
        (mx, a), (my, b) = _centred(x), _centred(y)
        return cls(len(x), mx, my, a.T @ a + b.T @ b, a.T @ b)

    def __add__(self, other: "Partial") -> "Partial":
        n = self.n + other.n
        dx, dy, share = other.mx - self.mx, other.my - self.my, other.n / n
        weight = self.n * share
        return Partial(n, self.mx + share * dx, self.my + share * dy,
                       self.same + other.same + weight * (np.outer(dx, dx) + np.outer(dy, dy)),
                       self.cross + other.cross + weight * np.outer(dx, dy))


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    rest = x - mean
    left = rest.mean(axis=0)    # what rounding left of the mean
    return mean + left, rest - left


def _as_batch(made: dict[int, Partial]) -> Iterator[pa.RecordBatch]:
    for tau, p in made.items():
        yield pa.RecordBatch.from_pydict({
            "lag": pa.array([tau], pa.int32()), "n": pa.array([p.n], pa.int64()), "mx": [p.mx.tolist()],
            "my": [p.my.tolist()], "same": [p.same.reshape(-1).tolist()], "cross": [p.cross.reshape(-1).tolist()]})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per lag; a task holds one partial result per lag and the row it reads."""
    acc: dict[int, Partial] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            tau, n = batch.column("lag")[k].as_py(), batch.column("n")[k].as_py()
            mx, my, same, cross = (batch.column(c)[k].values.to_numpy() for c in ("mx", "my", "same", "cross"))
            p = Partial(n, mx, my, same.reshape(len(mx), -1), cross.reshape(len(mx), -1))
            acc[tau] = acc[tau] + p if tau in acc else p
    yield from _as_batch(acc)


def lagged_moments(features: DataFrame, lags: Sequence[int], column: str = "x",
                   traj: Sequence[str] = ("traj_id",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(lag, i, j, n, mx_i, my_i, mx_j, my_j, same, cross)`` over all pairs (x now, y = x ``lag``
    later): means of both sides, and sums of products of deviations from these means.

    ``same`` sums dx_i dx_j + dy_i dy_j, ``cross`` sums dx_i dy_j. Each task folds its rows into one
    d x d block per lag before anything is shuffled; blocks are added up in two steps.
    """
    lags = check_lags(lags)
    rows, part, at_home = with_halo(features, max(lags), traj, chunk_rows)
    rows = (rows.select(*part, "frame", F.col(column).cast("array<double>").alias("x"),
                        at_home.alias("_own"))
            .repartition(*part).sortWithinPartitions(*part, "frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, Partial] = {}
        for block in sorted_blocks(batches, part, max(lags)):
            x = matrix_of(block.table["x"])
            for tau in lags:
                src, dst = block.pairs(tau)
                if len(src):
                    new = Partial.of(x[src], x[dst])
                    acc[tau] = acc[tau] + new if tau in acc else new
        yield from _as_batch(acc)

    partial = rows.mapInArrow(run, PARTIAL)
    some = partial.withColumn("_b", F.spark_partition_id() % FAN).repartition("lag", "_b").drop("_b")
    whole = some.mapInArrow(_merged, PARTIAL).repartition("lag").mapInArrow(_merged, PARTIAL)
    cells = whole.select("lag", "n", "mx", "my", "cross", F.posexplode("same").alias("_pos", "same"))
    i = F.floor(F.col("_pos") / F.size("mx")).cast("int")
    j = (F.col("_pos") % F.size("mx")).cast("int")
    return cells.select("lag", i.alias("i"), j.alias("j"), "n", *[F.col(m)[at].alias(f"{m}_{name}") for name, at in
                        (("i", i), ("j", j)) for m in ("mx", "my")], "same", F.col("cross")[F.col("_pos")].alias("cross"))


def raw_sums(moments: DataFrame) -> DataFrame:
    """``(lag, i, j, n, sx, sy, same, cross)``: plain sums of x_i, y_i and of products, from ``lagged_moments``."""
    n, product = F.col("n"), lambda a, b: F.col("n") * F.col(a) * F.col(b)
    return moments.select(
        "lag", "i", "j", "n", (n * F.col("mx_i")).alias("sx"), (n * F.col("my_i")).alias("sy"),
        (F.col("same") + product("mx_i", "mx_j") + product("my_i", "my_j")).alias("same"),
        (F.col("cross") + product("mx_i", "my_j")).alias("cross"))


@dataclass
class Moments:
    """One lag's mean, covariance and lagged covariance as arrays."""

    mean: np.ndarray
    cov: np.ndarray
    lagged: np.ndarray
    n: int


def assemble(pdf: pd.DataFrame) -> Moments:
    """Rows of ``lagged_moments`` of one lag -> arrays (d x d, whatever the frame count)."""
    d = int(pdf["i"].max()) + 1
    pdf = pdf.sort_values(["i", "j"])
    grid = lambda c: pdf[c].to_numpy(dtype=float).reshape(d, d)
    n = int(pdf["n"].iloc[0])
    mx, my = grid("mx_i")[:, 0], grid("my_i")[:, 0]
    apart = (mx - my) / 2       # both sides' means from their common one
    outer = np.outer(apart, apart)
    cross = grid("cross")
    return Moments(mx - apart, grid("same") / (2 * n) + outer, (cross + cross.T) / (2 * n) - outer, n)


def covariance_table(moments: DataFrame) -> DataFrame:
    """``(lag, i, j, n, c0, ct)``: mean-free, time-symmetrised covariances. One small group per
    lag; a self-join for the transpose would run the pass over the frames twice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = assemble(pdf)
        i, j = np.indices(m.cov.shape)
        return pd.DataFrame({"i": i.reshape(-1), "j": j.reshape(-1), "n": m.n,
                             "c0": m.cov.reshape(-1), "ct": m.lagged.reshape(-1)})

    return per_model(moments, ["lag"], run, [
        ("i", T.IntegerType()), ("j", T.IntegerType()), ("n", T.LongType()),
        ("c0", T.DoubleType()), ("ct", T.DoubleType())])


def shrink(cov: np.ndarray, n: int) -> np.ndarray:
    """Rao-Blackwellised Ledoit-Wolf shrinkage towards a multiple of the identity
    (Chen, Wiesel, Eldar, Hero, IEEE Trans. Signal Process. 58, 5016, 2010)."""
    p = len(cov)
    tr, tr2 = np.trace(cov), np.sum(cov * cov)
    top = (n - 2) / n * tr2 + tr * tr
    bottom = (n + 2) * (tr2 - tr * tr / p)
    rho = min(1.0, top / bottom) if bottom > 0 else 1.0
    return (1 - rho) * cov + rho * tr / p * np.eye(p)
