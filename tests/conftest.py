import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from tauframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.log.level": "OFF"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hidden_chain():
    """A reversible 9-state chain seen as 4 states: exact lumped matrices at lags 1..60."""
    rng = np.random.default_rng(7)
    group = np.repeat([0, 1, 2, 3], [3, 2, 2, 2])
    w = rng.random((9, 9)) * np.where(group[:, None] == group[None, :], 1.0, 0.05)
    w = w + w.T + np.diag(rng.random(9) * 6)
    hidden, pi = w / w.sum(1, keepdims=True), w.sum(1) / w.sum()
    seen = np.eye(4)[group]
    pop = pi @ seen
    power, out = np.eye(9), []
    for _ in range(60):
        power = power @ hidden
        out.append((seen.T @ np.diag(pi) @ power @ seen) / pop[:, None])
    return np.array(out)


def series_frame(spark, stack):
    rows = [(k, i, j, float(stack[k, i, j])) for k in range(stack.shape[0])
            for i in range(stack.shape[1]) for j in range(stack.shape[2])]
    return spark.createDataFrame(rows, "k int, i int, j int, p double")


def matrix(rows, value, d):
    out = np.zeros((d, d))
    for r in rows:
        out[r["i"], r["j"]] = r[value]
    return out


def stack(rows, index, value, d):
    depth = max(r[index] for r in rows) + 1
    out = np.zeros((depth, d, d))
    for r in rows:
        out[r[index], r["i"], r["j"]] = r[value]
    return out
