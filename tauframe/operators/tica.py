"""Time-lagged independent components and the selection of feature columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from tauframe.functions import dense
from tauframe.functions.arrays import matrix_of, rows_of
from tauframe.functions.hashing import digest_int
from tauframe.operators.covariance import Moments, assemble, lagged_moments, shrink
from tauframe.operators.grouped import per_model


def solve(m: Moments, shrinkage: bool = False, columns: Sequence[int] | None = None):
    cov = shrink(m.cov, m.n) if shrinkage else m.cov
    lagged = m.lagged
    if columns is not None:
        pick = np.ix_(list(columns), list(columns))
        cov, lagged = cov[pick], lagged[pick]
    return dense.generalised_eigen(lagged, cov)


def tica_timescales(moments: DataFrame, n: int = 10, shrinkage: bool = False, allow_fewer: bool = False) -> DataFrame:
    """``(lag, k, eigenvalue, t)``, k = 0..n-1; one small group per lag. Features that span fewer than
    ``n`` components are an error unless ``allow_fewer``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lam, _ = solve(assemble(pdf), shrinkage)
        if len(lam) < n and not allow_fewer:
            raise ValueError(f"the features span {len(lam)} components, fewer than the {n} asked for")
        lam = lam[:n]
        t = dense.relaxation_times(np.concatenate([[1.0], lam]), float(pdf["lag"].iloc[0]),
                                   len(lam))
        return pd.DataFrame({"k": range(len(lam)), "eigenvalue": lam,
                             "t": pd.Series([None if np.isnan(v) else v for v in t],
                                            dtype=object)})

    return per_model(moments, ["lag"], run, [("k", T.IntegerType()),
                                             ("eigenvalue", T.DoubleType()),
                                             ("t", T.DoubleType())])


@dataclass
class TicaModel:
    lag: int
    mean: np.ndarray
    vectors: np.ndarray      # features x components, unit variance
    eigenvalues: np.ndarray
    kinetic: bool

    def expression(self, column: str = "x") -> Column:
        """The projection of a feature column; a narrow, Arrow-batched step."""
        weights = self.vectors * self.eigenvalues if self.kinetic else self.vectors
        mean = self.mean

        @arrow_udf("array<double>")
        def project(x: pa.Array) -> pa.Array:
            return rows_of((matrix_of(x) - mean) @ weights if len(x)
                           else np.zeros((0, weights.shape[1])))

        return project(F.col(column).cast("array<double>"))

    def transform(self, features: DataFrame, column: str = "x", name: str = "y") -> DataFrame:
        """Project every frame."""
        return features.withColumn(name, self.expression(column)).drop(column)

    def table(self, spark, run_id: str = "tica") -> DataFrame:
        """Parameters as rows ``(run_id, lag, k, eigenvalue, mean, vector)``, to keep in Parquet."""
        rows = [(run_id, self.lag, k, float(self.eigenvalues[k]), self.mean.tolist(),
                 self.vectors[:, k].tolist()) for k in range(len(self.eigenvalues))]
        return spark.createDataFrame(rows, "run_id string, lag int, k int, eigenvalue double, "
                                           "mean array<double>, vector array<double>")

    @classmethod
    def from_table(cls, rows: DataFrame, kinetic: bool = True) -> "TicaModel":
        got = rows.orderBy("k").collect()
        return cls(got[0].lag, np.array(got[0].mean), np.array([r.vector for r in got]).T,
                   np.array([r.eigenvalue for r in got]), kinetic)


def fit_tica(features: DataFrame, lag: int, n_components: int = 10, kinetic_mapping: bool = True,
             shrinkage: bool = False, column: str = "x", allow_fewer: bool = False) -> TicaModel:
    """Fit on all frames. Only the d x d moments reach the driver, never frames.

    Directions without variance carry no component. Features that span fewer components than asked
    for are an error unless ``allow_fewer``; the model then holds as many as there are."""
    pdf = lagged_moments(features, [lag], column).toPandas()
    if pdf.empty:
        raise ValueError("no pair of frames is this lag apart")
    m = assemble(pdf)
    lam, v = solve(m, shrinkage)
    if len(lam) < n_components:
        if not allow_fewer:
            raise ValueError(f"the features span {len(lam)} components, fewer than the {n_components} asked for")
    k = min(n_components, len(lam))
    return TicaModel(lag, m.mean, v[:, :k], lam[:k], kinetic_mapping)


def greedy_columns(lagged: np.ndarray, cov: np.ndarray, n_cols: int, first: int,
                   per_round: int = 1) -> list[int]:
    """Columns whose Nystroem approximation of the lagged covariance is worst along its own
    leading eigenvectors (spectral oASIS; Litzinger et al., J. Chem. Theory Comput. 14, 2771,
    2018). Features are scaled to unit variance so that units do not decide.

    The approximation A = G[:,S] inv(G[S,S]) G[S,:] is carried along: a further column adds the rank-one
    term r r' / r_c with r = (G - A)[:, c] (Schur complement), and the eigenvectors of A are those of
    its small factor. Columns that the chosen ones explain wholly (r_c = 0) are taken last, by number."""
    scale = 1 / np.sqrt(np.clip(np.diag(cov), 1e-300, None))
    g = lagged * np.outer(scale, scale)
    d = len(g)
    n_cols = min(n_cols, d)
    tiny = 1e-12 * np.abs(np.diag(g)).max()
    left = np.diag(g).copy()                  # diagonal of G - A
    factor, signs = np.zeros((d, 0)), np.zeros(0)   # A = factor diag(signs) factor'
    chosen: list[int] = []

    def take(c: int) -> None:
        nonlocal factor, signs, left
        chosen.append(c)
        if abs(left[c]) <= tiny:
            return
        r = g[:, c] - (factor * signs) @ factor[c]
        u = r / np.sqrt(abs(left[c]))
        factor, signs = np.column_stack([factor, u]), np.append(signs, np.sign(left[c]))
        left = left - signs[-1] * u * u
        left[chosen] = 0.0

    take(first)
    while len(chosen) < n_cols:
        missing = np.abs(left)
        missing[missing <= tiny] = 0.0
        q, small = np.linalg.qr(factor)
        lam, w = np.linalg.eigh((small * signs) @ small.T)
        u = q @ w
        picked: list[int] = []
        for p in np.argsort(-np.abs(lam), kind="stable"):
            if len(picked) == per_round or len(chosen) + len(picked) == n_cols:
                break
            gain = missing * np.abs(u[:, p])
            gain[chosen + picked] = -1.0
            picked.append(int(gain.argmax()))
        if not picked:                        # nothing chosen explains anything: by number
            picked = [min(set(range(d)) - set(chosen))]
        for c in picked:
            take(c)
    return chosen


def select_features(moments: DataFrame, sizes: Sequence[int], seed: int = 0, per_round: int = 1,
                    first: int | None = None, allow_fewer: bool = False) -> DataFrame:
    """``(lag, n_cols, rank, feature_id, t)``: selected columns for each (lag, size), with the
    slowest timescale of the components built on them. The greedy order is nested, so one run
    per lag serves every size. The start column is seeded unless ``first`` is given. Sizes above
    the number of features are an error; ``allow_fewer`` reports the full set under its own size."""
    sizes = sorted({int(s) for s in sizes})
    if sizes[0] < 1:
        raise ValueError("at least one feature must be selected")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, lag = assemble(pdf), int(pdf["lag"].iloc[0])
        d = len(m.mean)
        if sizes[-1] > d and not allow_fewer:
            raise ValueError(f"{sizes[-1]} features were asked for, there are {d}")
        start = first if first is not None else start_column(seed, lag, d)
        order = greedy_columns(m.lagged, m.cov, min(max(sizes), d), start, per_round)
        parts = []
        for size in sorted({min(s, d) for s in sizes}):
            chosen = order[:size]
            lam, _ = solve(m, columns=chosen)
            t = dense.relaxation_times(np.array([1.0, lam[0]]), float(lag), 1)[0]
            parts.append(pd.DataFrame({"n_cols": size, "rank": range(len(chosen)),
                                       "feature_id": chosen,
                                       "t": pd.Series([None if np.isnan(t) else t] * len(chosen),
                                                      dtype=object)}))
        return pd.concat(parts, ignore_index=True)

    return per_model(moments, ["lag"], run, [("n_cols", T.IntegerType()), ("rank", T.IntegerType()),
                                             ("feature_id", T.IntegerType()),
                                             ("t", T.DoubleType())])


def start_column(seed: int, lag: int, n_features: int) -> int:
    """One feature, drawn without replacement by a hash of seed and lag."""
    return int(hashlib.md5(f"{seed}|{lag}".encode()).hexdigest()[:15], 16) % n_features


def start_column_of(seed: Column, lag: Column, n_features: int) -> Column:
    """``start_column`` as an expression."""
    digest = F.md5(F.concat_ws("|", seed.cast("string"), lag.cast("string")))
    return (digest_int(digest) % n_features).cast("int")


def timescale_curve(selection: DataFrame, full: DataFrame, n_features: int, dt: float) -> DataFrame:
    """``(lag, n_cols, t)`` in time units: slowest timescale against the number of features,
    ending with the full set."""
    some = selection.where(F.col("rank") == 0).select("lag", "n_cols", "t")
    whole = full.where(F.col("k") == 0).select("lag", F.lit(n_features).alias("n_cols"), "t")
    return some.unionByName(whole).withColumn("t", F.col("t") * dt)
