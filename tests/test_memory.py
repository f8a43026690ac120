"""Series checks, memory kernels, propagation and their error tables."""

import numpy as np
import pytest

from conftest import matrix, series_frame, stack
from tauframe.functions import dense
from tauframe.operators import memory, reversible, series, spectrum


@pytest.fixture(scope="module")
def chain(spark, hidden_chain):
    return series_frame(spark, hidden_chain).cache()


def test_kernel_identities(spark, hidden_chain, chain):
    dt = 0.1
    kernel = stack(memory.memory_kernel(chain, dt, 40).collect(), "n", "kernel", 4)
    scale = np.linalg.cond(hidden_chain[0]) * 1e-11
    assert np.abs(kernel[0]).max() < scale
    assert np.abs(kernel.sum(axis=2)).max() < 1e-8


def test_prediction_identities(hidden_chain, chain):
    dt, errors = 0.1, []
    kernel = memory.memory_kernel(chain, dt, 40).cache()
    for tau in (2, 5, 10, 20):
        rows = memory.predict_memory(chain, kernel, dt, tau, 50).collect()
        p = stack(rows, "idx", "p", 4)
        assert len(p) == 51
        assert np.abs(p.sum(axis=2) - 1).max() < 1e-10
        assert np.abs(p[:tau] - hidden_chain[:tau]).max() < 1e-12
        errors.append(np.abs(p - hidden_chain[:51]).max())
    assert errors == sorted(errors, reverse=True)
    assert rows[0].lag == pytest.approx((rows[0].idx + 1) * dt)


def test_prefix_check_can_fail(hidden_chain):
    dt = 0.1
    kernel = dense.memory_kernel(hidden_chain, dt, 20)
    bent = kernel.copy()
    bent[1] += 1e-6
    clean = dense.propagate_memory(hidden_chain, kernel, dt, 5, 20)
    moved = dense.propagate_memory(hidden_chain, bent, dt, 5, 20)
    assert np.abs(clean[:5] - hidden_chain[:5]).max() < 1e-12
    shift = np.abs(moved[4] - hidden_chain[4]).max()
    assert 0.2e-8 < shift < 5e-8


def test_kernel_reproduces_the_series(hidden_chain):
    """With the whole kernel the equation returns the series it came from."""
    kernel = dense.memory_kernel(hidden_chain, 1.0, 40)
    path = dense.propagate_memory(hidden_chain, kernel, 1.0, 40, 41)
    assert np.abs(path[:40] - hidden_chain[:40]).max() < 1e-9


def test_against_a_plain_loop(hidden_chain):
    t, dt = hidden_chain, 0.5
    inv = np.linalg.inv(t[0])
    rate = inv @ (t[1] - t[0]) / dt
    expect = []
    for n in range(12):
        memo = sum((t[n - m] @ expect[m] for m in range(n)), np.zeros((4, 4)))
        expect.append(inv @ (((t[n + 1] - t[n]) / dt - t[n] @ rate) / dt - memo))
    assert np.allclose(dense.memory_kernel(t, dt, 12), expect, rtol=1e-7, atol=1e-9)


def test_models_stay_apart(spark, hidden_chain, chain):
    other = series_frame(spark, hidden_chain[::-1].copy()[:30])
    from pyspark.sql import functions as F
    both = chain.withColumn("model", F.lit("a")).unionByName(other.withColumn("model", F.lit("b")))
    rows = memory.memory_kernel(both, 1.0, 5, keys=["model"]).collect()
    alone = stack(memory.memory_kernel(chain, 1.0, 5).collect(), "n", "kernel", 4)
    assert np.allclose(stack([r for r in rows if r.model == "a"], "n", "kernel", 4), alone)
    assert len(rows) == 2 * 5 * 16


def test_mean_integral_kernel(spark):
    rows = [(n, i, j, float(n == 1 and i == j)) for n in range(2) for i in range(2) for j in range(2)]
    kernel = spark.createDataFrame(rows, "n int, i int, j int, kernel double")
    out = {r.n: (r.time, r.mik) for r in memory.mean_integral_kernel(kernel, 1.0, 2).collect()}
    assert out == {0: (1.0, 0.0), 1: (2.0, pytest.approx(np.sqrt(2) / 2))}
    with pytest.raises(ValueError):
        memory.mean_integral_kernel(kernel, 1.0, 0)
    with pytest.raises(Exception, match="shorter"):
        memory.mean_integral_kernel(kernel, 1.0, 3).collect()


def test_markov_power(spark):
    t = np.array([[0.9, 0.1], [0.2, 0.8]])
    made = series_frame(spark, np.array([t, t, t]))
    rows = memory.predict_markov(made, 0.1, tau=2, end=5).collect()
    assert np.allclose(matrix([r for r in rows if r.r == 2], "p", 2), [[.83, .17], [.34, .66]])
    assert {round(r.lag, 9) for r in rows} == {0.2, 0.4}
    start = memory.predict_markov(made, 0.1, tau=2, end=5, add_identity=True).collect()
    assert np.allclose(matrix([r for r in start if r.r == 0], "p", 2), np.eye(2))


def test_rmse_by_hand(hidden_chain, chain):
    kernel = memory.memory_kernel(chain, 1.0, 40).cache()
    plain = {r.tau: r for r in memory.rmse_sweep(chain, kernel, 1.0, 30, taus=[4, 9]).collect()}
    old = {r.tau: r for r in memory.rmse_sweep(chain, kernel, 1.0, 30, taus=[4, 9],
                                               compat=True).collect()}
    pi = dense.stationary_vector(hidden_chain[10])
    k = dense.memory_kernel(hidden_chain, 1.0, 40)
    for tau in (4, 9):
        diff = dense.propagate_memory(hidden_chain, k, 1.0, tau, 30)[:30] - hidden_chain[:30]
        square = ((np.diag(pi) @ diff) ** 2).sum()
        assert plain[tau].memory_rmse == pytest.approx(100 * np.sqrt(square / 16 / 30), rel=1e-6)
        assert old[tau].memory_rmse == pytest.approx(100 * np.sqrt(square / 16 / 31), rel=1e-6)
        for rows, base in ((plain, tau - 1), (old, tau)):
            power, total, count = np.eye(4), 0.0, 30 // tau
            for r in range(1, count + 1):
                power = power @ hidden_chain[base]
                total += ((np.diag(pi) @ (power - hidden_chain[r * tau - 1])) ** 2).sum()
            assert rows[tau].markov_rmse == pytest.approx(100 * np.sqrt(total / 16 / count), rel=1e-6)


def test_integer_steps_where_float_time_truncates(hidden_chain, chain):
    """dt = 0.1: the truncated float index of the published tool goes wrong for some tau."""
    label = np.cumsum(np.full(33 // 3, 3 * 0.1))
    assert ((label / 0.1 - 1).astype(int) != 3 * np.arange(1, 12) - 1).any()
    kernel = memory.memory_kernel(chain, 0.1, 40).cache()
    a = memory.rmse_sweep(chain, kernel, 0.1, 33, taus=[3]).collect()[0]
    unit = memory.memory_kernel(chain, 1.0, 40)
    b = memory.rmse_sweep(chain, unit, 1.0, 33, taus=[3]).collect()[0]
    assert a.markov_rmse == pytest.approx(b.markov_rmse, rel=1e-9)


def test_comparison_table(hidden_chain, chain):
    kernel = memory.memory_kernel(chain, 1.0, 40).cache()
    pred = memory.predict_memory(chain, kernel, 1.0, 10, 50)
    mark = memory.predict_markov(chain, 1.0, 10, 50)
    rows = memory.comparison_table(chain, pred, mark, tau=10, every=1).collect()
    assert len(rows) == 51 * 4
    with_power = {r.k for r in rows if r.markov is not None}
    assert with_power == {9, 19, 29, 39, 49}
    first = [r for r in rows if r.k == 9]
    assert all(r.markov == pytest.approx(r.observed) == pytest.approx(r.memory) for r in first)
    none = memory.comparison_table(chain, pred, None, tau=10, every=10, diagonal=False,
                                   complete=False).collect()
    assert len(none) == 6 * 16 and all(r.markov is None for r in none)


def test_comparison_keeps_what_thinning_skips(hidden_chain, chain):
    kernel = memory.memory_kernel(chain, 1.0, 60 - 1).cache()
    pred = memory.predict_memory(chain, kernel, 1.0, 20, 50)
    mark = memory.predict_markov(chain, 1.0, 20, 50)
    rows = memory.comparison_table(chain, pred, mark, tau=20, every=10, identity=True).collect()
    assert {r.k for r in rows} == set(range(-1, 51))
    assert {r.k for r in rows if r.markov is not None} == {-1, 19, 39}
    assert {r.k for r in rows if r.observed is not None} == {-1, 0, 10, 20, 30, 40, 50}
    assert all(r.memory == 1 for r in rows if r.k == -1)


def test_wrong_sizes(chain):
    kernel = memory.memory_kernel(chain, 1.0, 12).cache()
    for call in (lambda: memory.predict_memory(chain, kernel, 1.0, 1, 10),
                 lambda: memory.predict_memory(chain, kernel, 1.0, 10, 10),
                 lambda: memory.predict_markov(chain, 1.0, 10, 10),
                 lambda: memory.memory_kernel(chain, 1.0, 0),
                 lambda: memory.rmse_sweep(chain, kernel, 1.0, 5, taus=[5])):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: memory.predict_memory(chain, kernel, 1.0, 11, 20),
                 lambda: memory.rmse_sweep(chain, kernel, 1.0, 30, taus=[3]),
                 lambda: memory.memory_kernel(chain, 1.0, 60)):
        with pytest.raises(Exception):
            call().collect()


def test_derivative(spark):
    made = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 0.8), (2, 0, 0, 0.7)],
                                 "k int, i int, j int, p double")
    rows = sorted((r.k, r.dp) for r in series.derivative(made, 0.1).collect())
    assert rows == [(0, pytest.approx(-2)), (1, pytest.approx(-1))]


def test_orientation(spark):
    col = np.array([[0.9, 0.2], [0.1, 0.8]])
    made = series_frame(spark, np.array([col] * 4))
    flags = series.normalisation(made).collect()[0]
    assert (flags.row_ok, flags.col_ok) == (False, True)
    out = stack(series.orient(made).collect(), "k", "p", 2)
    assert np.allclose(out, np.array([col.T] * 4))
    again = stack(series.orient(series_frame(spark, out)).collect(), "k", "p", 2)
    assert np.allclose(again, out)
    with pytest.raises(Exception, match="normalised"):
        series.orient(series_frame(spark, np.array([[[1.0, 1.0], [2.0, 3.0]]] * 4))).collect()


def test_flatten_round_trip(spark, chain, hidden_chain):
    flat = series.flatten(chain)
    assert all(len(r.m) == 16 for r in flat.collect())
    assert np.allclose(stack(series.unflatten(flat).collect(), "k", "p", 4), hidden_chain)
    row = series.with_time(flat, 0.5).where("k = 3").collect()[0].row
    assert row[0] == 1.5 and len(row) == 17
    with pytest.raises(Exception, match="square"):
        series.unflatten(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "k int, m array<double>")
                         ).collect()


def test_series_gap_is_an_error(chain):
    with pytest.raises(Exception, match="gap"):
        memory.memory_kernel(chain.where("k <> 3"), 1.0, 8).collect()


@pytest.mark.parametrize("t", [[[.9, .1], [.2, .8]], [[9., 1.], [4., 16.]], [[.9, .1], [.2, .8000001]]])
def test_passage_times(spark, t):
    tpm = series_frame(spark, np.array([t])).drop("k")
    m = matrix(spectrum.mean_first_passage(tpm, 1.0).collect(), "mfpt", 2)
    assert np.allclose(m, [[0, 10], [5, 0]], atol=1e-4)


def test_passage_times_fundamental_matrix(spark, hidden_chain):
    """Against the fundamental matrix (Kemeny & Snell) and with a clipped negative entry."""
    t = hidden_chain[0].copy()
    pi = dense.stationary_vector(t)
    z = np.linalg.inv(np.eye(4) - t + np.outer(np.ones(4), pi))
    expect = (np.diag(z)[None, :] - z) / pi[None, :] * 3.0
    tpm = series_frame(spark, t[None]).drop("k")
    assert np.allclose(matrix(spectrum.mean_first_passage(tpm, 3.0).collect(), "mfpt", 4), expect)
    bad = t.copy()
    bad[0, 3] = -0.2
    clipped = np.clip(bad, 0, None)
    clipped /= clipped.sum(1, keepdims=True)
    a = spectrum.mean_first_passage(series_frame(spark, bad[None]).drop("k"), 3.0)
    assert np.allclose(matrix(a.collect(), "mfpt", 4), dense.passage_times(clipped, 3.0))


def test_stationary(spark):
    tpm = series_frame(spark, np.array([[[.9, .1], [.2, .8]]])).drop("k")
    out = {r.i: r.p for r in spectrum.stationary(tpm, []).collect()}
    assert out == pytest.approx({0: 2 / 3, 1: 1 / 3})


def test_small_matrix_edits(spark):
    m = spark.createDataFrame([(0, 0, -0.1), (0, 1, 0.4), (1, 0, 0.2), (1, 1, 0.8)],
                              "i int, j int, p double")
    assert reversible.clip_negative(m).where("p < 0").count() == 0
    assert [(r.i, r.j) for r in reversible.drop_state(m, 0).collect()] == [(1, 1)]
    flipped = {(r.i, r.j): r.p for r in reversible.transpose(m).collect()}
    assert flipped[(1, 0)] == 0.4 and flipped[(0, 1)] == 0.2


def test_model_object(spark, hidden_chain, chain):
    flat = series.flatten(chain)
    model = memory.MemoryModel.from_flat(flat, 60, 4, 0.1)
    with pytest.raises(ValueError, match="kernel first"):
        model.predict(5, 20)
    full = model.with_kernel(20)
    assert model.kernel is None and full.kernel_steps == 20
    p = stack(full.predict(5, 30).collect(), "idx", "p", 4)
    k = dense.memory_kernel(hidden_chain, 0.1, 20)
    assert np.allclose(p, dense.propagate_memory(hidden_chain, k, 0.1, 5, 30))
    assert full.mean_integral_kernel(10).count() == 10 and full.kernel_table().count() == 320
    assert full.comparison(5, 30, every=10).where("observed is not null").count() == 4 * 4
    assert full.rmse(end=12).count() == 10
    assert full.derivative().count() == 59 * 16 and full.initial_rate().count() == 16
    with pytest.raises(ValueError, match="needed"):
        full.rmse(end=30)
    # a column-normalised input gives the same model
    turned = memory.MemoryModel.from_flat(series.flatten(reversible.transpose(chain)), 60, 4, 0.1)
    assert np.allclose(stack(turned.series.collect(), "k", "p", 4), hidden_chain)


def test_lag_steps():
    assert series.lag_steps(0.1, 50, 0.1, 0.1) == (500, 1, 1)
    assert series.lag_steps(1.0, 5.0, 0.5, 0.1) == (9, 5, 10)
    with pytest.raises(ValueError):
        series.lag_steps(0.1, 1, 0.01, 0.1)


def test_series_start_and_stride(spark):
    d = spark.createDataFrame([(0, f, (f // 3) % 2) for f in range(60)],
                              "traj_id int, frame bigint, state int")
    a = stack(series.matrix_series(d, 3, stride=2, start=5).collect(), "k", "p", 2)
    one = stack(series.matrix_series(d, 9).collect(), "k", "p", 2)
    assert np.allclose(a, one[[4, 6, 8]])
