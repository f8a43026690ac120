"""Lumping of microstates into metastable macrostates (robust Perron cluster analysis)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tauframe.functions import dense
from tauframe.operators.grouped import field_type, per_model
from tauframe.session import materialise


def simplex_corners(vectors: np.ndarray) -> list[int]:
    """Inner simplex: rows that span the largest simplex, found by repeated projection."""
    rest = vectors - vectors[np.linalg.norm(vectors, axis=1).argmax()]
    corners = [int(np.linalg.norm(vectors, axis=1).argmax())]
    for _ in range(vectors.shape[1] - 1):
        length = np.linalg.norm(rest, axis=1)
        at = int(length.argmax())
        corners.append(at)
        if length[at] == 0:
            break
        axis = rest[at] / length[at]
        rest = rest - np.outer(rest @ axis, axis)
    return corners


def feasible(inner: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Complete an (m-1)x(m-1) block to a transformation whose memberships are non-negative
    and sum to one (Roeblitz & Weber, Adv. Data Anal. Classif. 7, 147, 2013)."""
    m = len(inner) + 1
    a = np.zeros((m, m))
    a[1:, 1:] = inner
    a[1:, 0] = -inner.sum(axis=1)
    a[0] = -(vectors[:, 1:] @ a[1:]).min(axis=0)
    return a / a[0].sum()


def crispness(inner: np.ndarray, vectors: np.ndarray) -> float:
    a = feasible(inner, vectors)
    if (a[0] <= 0).any():
        return np.inf
    return -float(((a ** 2) / a[0]).sum())


def simplex_search(fn, x0: np.ndarray, max_iter: int = 4000, tol: float = 1e-10) -> np.ndarray:
    """Derivative-free descent (Nelder & Mead 1965) for a few unknowns."""
    n = len(x0)
    pts = np.vstack([x0, x0 + np.diag(np.where(x0 != 0, 0.05 * x0, 0.00025))])
    val = np.array([fn(p) for p in pts])
    for _ in range(max_iter):
        order = val.argsort(kind="stable")
        pts, val = pts[order], val[order]
        if val[-1] - val[0] < tol and np.abs(pts[1:] - pts[0]).max() < 1e-8:
            return pts[0]
        mid = pts[:-1].mean(axis=0)
        trial = lambda t: mid + t * (pts[-1] - mid)
        reflected = trial(-1.0)
        f = fn(reflected)
        if f < val[0]:
            wider = trial(-2.0)
            g = fn(wider)
            pts[-1], val[-1] = (wider, g) if g < f else (reflected, f)
        elif f < val[-2]:
            pts[-1], val[-1] = reflected, f
        else:
            inward = trial(-0.5) if f < val[-1] else trial(0.5)
            g = fn(inward)
            if g < min(f, val[-1]):
                pts[-1], val[-1] = inward, g
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [fn(p) for p in pts[1:]]
    raise ValueError(f"the search did not settle within {max_iter} steps")


def memberships(flux: np.ndarray, n_macro: int, optimise: bool = True) -> np.ndarray:
    """(microstates x macrostates), rows sum to one."""
    if n_macro < 2 or n_macro > len(flux):
        raise ValueError("number of macrostates must be between 2 and the number of states")
    _, vectors, _ = dense.reversible_spectrum(flux)
    v = vectors[:, :n_macro] / vectors[0, 0]        # the constant vector becomes 1
    v[:, 0] = 1.0
    a = np.linalg.inv(v[simplex_corners(v)])
    inner = a[1:, 1:]
    if optimise:
        best = simplex_search(lambda z: crispness(z.reshape(inner.shape), v), inner.reshape(-1))
        if crispness(best.reshape(inner.shape), v) < crispness(inner, v):
            inner = best.reshape(inner.shape)
    return v @ feasible(inner, v)


def lump_states(counts: DataFrame, n_macro: int, keys: Sequence[str] = ("lag",),
                optimise: bool = True) -> DataFrame:
    """``(keys.., state, macrostate, membership)`` from transition counts of one lag.

    Counts are symmetrised and must be ergodic (trim first). Macrostates are numbered by their
    smallest microstate, so the numbering does not depend on eigenvector signs."""
    state = field_type(counts, "i")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, states = dense.square(pdf, "n")
        chi = memberships((c + c.T) / 2, n_macro, optimise)
        raw = chi.argmax(axis=1)
        _, first = np.unique(raw, return_index=True)
        number = {raw[at]: rank for rank, at in enumerate(sorted(first))}
        return pd.DataFrame({"state": states, "macrostate": [number[r] for r in raw],
                             "membership": chi.max(axis=1)})

    return per_model(counts, keys, run, [("state", state), ("macrostate", T.IntegerType()),
                                         ("membership", T.DoubleType())])


def apply_lumping(dtraj: DataFrame, lumping: DataFrame) -> DataFrame:
    """``(traj_id, frame, state = macrostate)``. Frames in trimmed states are left out, which
    splits their trajectory there.

    A state may hold a third of all frames, so frames must not be shuffled by state. The map
    (one row per microstate) is saved first: its file size is then known to the planner, which
    broadcasts it below the broadcast threshold."""
    named = materialise(lumping.select("state", F.col("macrostate").alias("_macro")), "lumping")
    return (dtraj.join(named, "state")
            .select("traj_id", "frame", F.col("_macro").alias("state")))
