"""Small dense linear algebra used inside grouped tasks.

Matrices here have one row per state of one model; they never grow with the number of frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def state_list(pdf: pd.DataFrame) -> list:
    return sorted(set(pdf["i"]) | set(pdf["j"]))


def square(pdf: pd.DataFrame, value: str, states: list | None = None) -> tuple[np.ndarray, list]:
    """Coordinate rows -> dense matrix over the sorted states."""
    states = state_list(pdf) if states is None else states
    index = pd.Index(states)
    out = np.zeros((len(states), len(states)))
    np.add.at(out, (index.get_indexer(pdf["i"]), index.get_indexer(pdf["j"])),
              pdf[value].to_numpy(dtype=float))
    return out, states


def tensor(pdf: pd.DataFrame, value: str, states: list | None = None) -> tuple[np.ndarray, list]:
    """Rows (k, i, j, value) -> (L, d, d); k must cover 0..L-1."""
    states = state_list(pdf) if states is None else states
    index = pd.Index(states)
    k = pdf["k"].to_numpy(dtype=np.int64)
    depth = int(k.max()) + 1
    if len(np.unique(k)) != depth or k.min() != 0:
        raise ValueError("matrix series has a gap: every step from 0 up is needed")
    out = np.zeros((depth, len(states), len(states)))
    np.add.at(out, (k, index.get_indexer(pdf["i"]), index.get_indexer(pdf["j"])),
              pdf[value].to_numpy(dtype=float))
    return out, states


def long_form(stack: np.ndarray, states: list, value: str, k0: int = 0) -> pd.DataFrame:
    """(L, d, d) -> rows (k, i, j, value)."""
    depth, d, _ = stack.shape
    labels = np.array(states, dtype=object)
    return pd.DataFrame({
        "k": np.repeat(np.arange(k0, k0 + depth), d * d),
        "i": np.tile(np.repeat(labels, d), depth),
        "j": np.tile(labels, depth * d),
        value: stack.reshape(-1),
    })


def rows_to_one(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts, dtype=float), where=total > 0)


def reversible_spectrum(flux: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (descending), right eigenvectors and populations of ``diag(pi)^-1 flux``
    for a symmetric ``flux`` with positive row sums."""
    weight = flux.sum(axis=1)
    root = np.sqrt(weight)
    lam, u = np.linalg.eigh(flux / np.outer(root, root))
    lam, u = lam[::-1], u[:, ::-1]
    vectors = u / root[:, None]
    scale = np.sqrt(np.einsum("ik,i,ik->k", vectors, weight / weight.sum(), vectors))
    return lam, vectors / scale, weight / weight.sum()


def relaxation_times(lam: np.ndarray, lag: float, n: int) -> np.ndarray:
    """``-lag / ln(lambda_k)`` for k = 1..n; NaN where the eigenvalue is not in (0, 1)."""
    out = np.full(n, np.nan)
    sub = lam[1:n + 1]
    ok = (sub > 0) & (sub < 1)
    out[:len(sub)][ok] = -lag / np.log(sub[ok])
    return out


def stationary_vector(tpm: np.ndarray) -> np.ndarray:
    """The row vector with ``pi T = pi`` and sum 1, from the null space of ``T' - 1``."""
    d = len(tpm)
    system = np.vstack([tpm.T - np.eye(d), np.ones(d)])
    rhs = np.zeros(d + 1)
    rhs[-1] = 1.0
    pi, *_ = np.linalg.lstsq(system, rhs, rcond=None)
    return pi


def memory_kernel(series: np.ndarray, dt: float, steps: int) -> np.ndarray:
    """Memory kernel of the discretised generalised master equation, by forward substitution.

    With R = T0^-1 (T1 - T0)/dt, every K[n] balances what the memoryless rate R leaves
    unexplained at step n against the memory already assigned to steps before n.
    """
    if steps > len(series) - 1:
        raise ValueError("memory kernel needs one more matrix than steps")
    slope = np.diff(series, axis=0) / dt
    rate = np.linalg.solve(series[0], slope[0])
    unexplained = (slope[:steps] - series[:steps] @ rate) / dt
    kernel = np.zeros_like(unexplained)
    for n in range(steps):
        known = np.einsum("mab,mbc->ac", series[n:0:-1], kernel[:n])
        kernel[n] = np.linalg.solve(series[0], unexplained[n] - known)
    return kernel


def propagate_memory(series: np.ndarray, kernel: np.ndarray, dt: float, tau: int,
                     end: int) -> np.ndarray:
    """Extend the first ``tau`` matrices to ``end + 1`` with a kernel cut at ``tau - 1`` terms."""
    depth = tau - 1
    if len(kernel) < depth or len(series) < tau:
        raise ValueError("series or kernel is shorter than the memory time")
    path = np.empty((end + 1, *series.shape[1:]))
    path[:tau] = series[:tau]
    rate = np.linalg.solve(series[0], (series[1] - series[0]) / dt)
    memory = kernel[:depth]
    for n in range(tau - 2, end):
        recent = path[n - depth + 1:n + 1][::-1]
        slope = path[n] @ rate + dt * np.einsum("mab,mbc->ac", recent, memory)
        path[n + 1] = path[n] + dt * slope
    return path


def matrix_powers(tpm: np.ndarray, count: int) -> np.ndarray:
    out = np.empty((count, *tpm.shape))
    current = np.eye(len(tpm))
    for r in range(count):
        current = current @ tpm
        out[r] = current
    return out


def passage_times(tpm: np.ndarray, lag: float) -> np.ndarray:
    """Mean first-passage times m[i, j] from i to j; the diagonal is 0."""
    d = len(tpm)
    out = np.zeros((d, d))
    for target in range(d):
        rest = np.delete(np.arange(d), target)
        inner = np.eye(d - 1) - tpm[np.ix_(rest, rest)]
        out[rest, target] = np.linalg.solve(inner, np.full(d - 1, float(lag)))
    return out


def inverse_sqrt(cov: np.ndarray, cutoff: float = 1e-10) -> np.ndarray:
    """Whitening matrix L (d x r) with L' cov L = 1 on the directions above the cutoff."""
    lam, u = np.linalg.eigh(cov)
    keep = lam > cutoff * lam[-1]
    return u[:, keep] / np.sqrt(lam[keep])


def generalised_eigen(lagged: np.ndarray, cov: np.ndarray, cutoff: float = 1e-10
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Solve ``lagged v = lambda cov v`` (both symmetric) by whitening; descending lambda.

    Signs are fixed by making each vector's largest entry positive."""
    white = inverse_sqrt(cov, cutoff)
    lam, w = np.linalg.eigh(white.T @ lagged @ white)
    lam, v = lam[::-1], (white @ w)[:, ::-1]
    flip = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return lam, v * np.where(flip == 0, 1.0, flip)


def fit_reversible(counts: np.ndarray, tol: float = 1e-11, max_steps: int = 200) -> np.ndarray:
    """Detailed-balance flux X of the maximum-likelihood reversible transition matrix.

    At the maximum (Prinz et al., J. Chem. Phys. 134, 174105, 2011) the flux between two states is
    ``(c_ij + c_ji) / (q_i + q_j)``. The logarithms of q maximise a concave function of the counts
    that leave a state, so Newton steps with step halving converge whatever the exchange rates; each
    state's equation holds to ``tol`` of its own counts, or, where rounding does not let ``max_steps``
    reach that (counts many orders of magnitude apart), to 1e-7 of them. Raises if neither is reached,
    or if states are connected in one direction only (then there is no maximum; trim the counts first).
    """
    counts = np.asarray(counts, float)
    d = len(counts)
    cross = counts + counts.T
    np.fill_diagonal(cross, 0.0)
    leaving = counts.sum(axis=1) - np.diag(counts)
    group = _one_way_free_groups(counts)
    same = (group[:, None] == group[None, :]).astype(float)
    theta, scale = np.zeros(d), np.maximum(leaving, 1e-300)

    def objective(t: np.ndarray) -> float:
        return float(leaving @ t - 0.5 * (cross * np.logaddexp(t[:, None], t[None, :])).sum())

    for _ in range(max_steps):
        share = 1 / (1 + np.exp(np.clip(theta[None, :] - theta[:, None], -700, 700)))
        gradient = leaving - (cross * share).sum(axis=1)
        if (np.abs(gradient) <= tol * scale).all():
            break
        w = cross * share * (1 - share)
        # one free constant per group of connected states: fixed by the group's mean
        curvature = np.diag(w.sum(axis=1)) - w + same * max(w.max(), 1e-300)
        step = np.linalg.solve(curvature + np.diag(leaving == 0).astype(float), gradient)
        step -= (same @ step) / same.sum(axis=1)
        step *= min(1.0, 10.0 / max(np.abs(step).max(), 1e-300))
        here, size = objective(theta), 1.0
        while size > 1e-10 and objective(theta + size * step) < here - 1e-12 * abs(here):
            size /= 2
        theta = theta + size * step
    else:
        # rounding sets the limit when counts differ by many orders of magnitude
        if not (np.abs(gradient) <= 1e-7 * scale).all():
            raise ValueError("the reversible maximum-likelihood fit did not converge")
    q = np.exp(theta)
    flux = (counts + counts.T) / (q[:, None] + q[None, :])
    total = flux.sum()
    return flux / total if total > 0 else flux


def _one_way_free_groups(counts: np.ndarray) -> np.ndarray:
    """A group number per state; raises where a group of connected states has no way back."""
    d = len(counts)
    reach = (counts > 0) | np.eye(d, dtype=bool)
    while True:
        wider = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (wider == reach).all():
            break
        reach = wider
    if (reach != reach.T).any():
        raise ValueError("states are connected in one direction only; trim the counts first")
    return reach.argmax(axis=1)


def largest_connected(counts: np.ndarray, cutoff: float = 0.0) -> np.ndarray:
    """Mask of the strongly connected set that holds most counts."""
    reach = (counts > cutoff) | np.eye(len(counts), dtype=bool)
    while True:
        wider = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
        if (wider == reach).all():
            break
        reach = wider
    mutual = reach & reach.T
    leader = mutual.argmax(axis=1)          # smallest member names its component
    weight = np.bincount(leader, weights=counts.sum(axis=1) + counts.sum(axis=0),
                         minlength=len(counts))
    return leader == weight.argmax()
