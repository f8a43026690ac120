"""Spectra, reversible estimation, trimming, lumping, features, clustering, sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import matrix
from tauframe.operators import (clustering, covariance, features, lumping, reversible,
                                sampling, spectrum, tica)

ATOMS = [2, 5, 6, 7, 9, 11, 15, 16, 17, 18]   # 1-based example list


def count_frame(spark, c, **keys):
    rows = [(1, i, j, int(c[i, j])) for i in range(len(c)) for j in range(len(c)) if c[i, j]]
    return spark.createDataFrame(rows, "lag int, i int, j int, n bigint")


@pytest.fixture(scope="module")
def blocks():
    """Twelve states in three blocks that exchange rarely."""
    rng = np.random.default_rng(5)
    group = np.repeat([0, 1, 2], 4)
    c = rng.integers(40, 90, (12, 12)) * (group[:, None] == group[None, :])
    c = c + rng.integers(1, 3, (12, 12))
    return c, group


def test_timescales_against_numpy(spark, blocks):
    c, _ = blocks
    sym = (c + c.T) / 2
    lam = np.sort(np.linalg.eigvals(sym / sym.sum(1, keepdims=True)).real)[::-1]
    rows = sorted(spectrum.implied_timescales(count_frame(spark, c), n=4).collect(),
                  key=lambda r: r.k)
    assert np.allclose([r.eigenvalue for r in rows], lam[1:5])
    for r in rows:
        assert r.t == (pytest.approx(-1 / np.log(r.eigenvalue)) if r.eigenvalue > 0 else None)


def test_negative_eigenvalue_has_no_timescale(spark):
    rows = spectrum.implied_timescales(count_frame(spark, np.array([[1, 9], [9, 1]])), n=2).collect()
    assert [(r.k, r.t) for r in rows] == [(0, None), (1, None)]
    assert rows[0].eigenvalue == pytest.approx(-0.8) and rows[1].eigenvalue is None
    with pytest.raises(ValueError):
        spectrum.implied_timescales(count_frame(spark, np.eye(2)), keys=[])


def test_summary_uses_population_deviation(spark):
    its = spark.createDataFrame([(b, 1, 0, t) for b, t in enumerate([1.0, 2.0, 3.0, None])],
                                "boot_id int, lag int, k int, t double")
    r = spectrum.timescale_summary(its).collect()[0]
    assert (r.mean_t, r.n_finite) == (2.0, 3) and r.std_t == pytest.approx(np.sqrt(2 / 3))


def test_reversible_mle(spark, blocks):
    c, _ = blocks
    rows = reversible.reversible_mle(count_frame(spark, c)).collect()
    t = matrix(rows, "p", 12)
    pi = np.array([next(r.pi for r in rows if r.i == i) for i in range(12)])
    assert np.allclose(t.sum(1), 1)
    assert np.allclose(pi[:, None] * t, (pi[:, None] * t).T)
    assert np.allclose(pi @ t, pi)
    score = lambda m: (c * np.log(m)).sum()
    sym = (c + c.T) / 2
    assert score(t) >= score(sym / sym.sum(1, keepdims=True))
    # no small reversible change of the flux does better
    rng = np.random.default_rng(0)
    flux = pi[:, None] * t
    for _ in range(20):
        e = rng.normal(size=flux.shape) * 1e-3 * flux
        near = flux + (e + e.T) / 2
        assert score(near / near.sum(1, keepdims=True)) <= score(t) + 1e-9


def test_mle_of_symmetric_counts_is_exact(spark):
    c = np.array([[5, 2], [2, 9]])
    t = matrix(reversible.reversible_mle(count_frame(spark, c)).collect(), "p", 2)
    assert np.allclose(t, c / c.sum(1, keepdims=True))


def test_ergodic_trimming(spark):
    c = np.zeros((6, 6), int)
    c[0, 1], c[1, 0], c[0, 0] = 5, 5, 3          # small loop
    c[2, 3], c[3, 4], c[4, 2] = 50, 50, 50       # large loop
    c[4, 5], c[1, 2] = 7, 1                      # dead end, one-way bridge
    counts = count_frame(spark, c)
    keep = reversible.ergodic_states(counts)
    assert sorted((r.state, r.new_state) for r in keep.collect()) == [(2, 0), (3, 1), (4, 2)]
    kept = {(r.i, r.j): r.n for r in reversible.trim_counts(counts, keep).collect()}
    assert kept == {(0, 1): 50, (1, 2): 50, (2, 0): 50}
    none = reversible.ergodic_states(counts, cutoff=50.0)
    assert none.count() == 1


def test_lumping_finds_blocks(spark, blocks):
    c, group = blocks
    for optimise in (True, False):
        rows = lumping.lump_states(count_frame(spark, c), 3, optimise=optimise).collect()
        found = [r.macrostate for r in sorted(rows, key=lambda r: r.state)]
        assert found == group.tolist()
        assert all(0.5 < r.membership <= 1 + 1e-9 for r in rows)


def test_memberships_are_valid(blocks):
    c, _ = blocks
    chi = lumping.memberships((c + c.T) / 2, 3)
    assert np.allclose(chi.sum(1), 1) and chi.min() > -1e-9
    with pytest.raises(ValueError):
        lumping.memberships((c + c.T) / 2, 1)
    with pytest.raises(ValueError):
        lumping.memberships((c + c.T) / 2, 13)


def test_optimising_memberships_does_not_make_them_fuzzier(blocks):
    c, _ = blocks
    crisp = lambda chi: (chi ** 2).sum(axis=0) @ (1 / chi.sum(axis=0))
    sym = (c + c.T) / 2
    assert crisp(lumping.memberships(sym, 3)) >= crisp(lumping.memberships(sym, 3, False)) - 1e-6


def test_apply_lumping_leaves_trimmed_states_out(spark):
    d = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")], "traj_id int, frame bigint, state string")
    m = spark.createDataFrame([("a", 1), ("c", 0)], "state string, macrostate int")
    assert sorted(map(tuple, lumping.apply_lumping(d, m).collect())) == [(0, 0, 1), (0, 2, 0)]


def test_rayleigh_score(spark, blocks):
    c, _ = blocks
    rng = np.random.default_rng(9)
    test = rng.poisson(c * 0.5)
    rows = [(0, 0, i, j, int(test[i, j]), int(c[i, j])) for i in range(12) for j in range(12)]
    df = spark.createDataFrame(rows, "repeat int, fold int, i int, j int, n_test bigint, n_train bigint")
    r = spectrum.rayleigh_scores(df, 3).collect()[0]
    sym, tst = (c + c.T) / 2, (test + test.T) / 2
    lam, v = np.linalg.eig(sym / sym.sum(1, keepdims=True))
    top = np.argsort(-lam.real)[:4]
    v = v.real[:, top]
    s = np.diag(tst.sum(1) / tst.sum())
    score = np.trace(v.T @ (tst / tst.sum()) @ v @ np.linalg.inv(v.T @ s @ v))
    assert r.train_score == pytest.approx(lam.real[top].sum())
    assert r.test_score == pytest.approx(score)
    same = df.withColumn("n_test", F.col("n_train"))
    r = spectrum.rayleigh_scores(same, 3).collect()[0]
    assert r.test_score == pytest.approx(r.train_score)


def test_score_without_test_counts_is_null(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 0, 4), (0, 0, 1, 0, 0, 4), (0, 0, 0, 0, 0, 3)],
                               "repeat int, fold int, i int, j int, n_test bigint, n_train bigint")
    assert spectrum.rayleigh_scores(df, 1).collect()[0].test_score is None


# -- features ------------------------------------------------------------------------------

def test_pairs(spark):
    atoms = spark.createDataFrame([(a - 1,) for a in ATOMS + [2, 5]], "atom int")
    pairs = features.pair_list(features.pair_table(atoms))
    assert len(pairs) == 45 and pairs[0] == (1, 4) and pairs[-1] == (16, 17)
    assert pairs == sorted(pairs) and all(i < j for i, j in pairs)
    ids = sorted(r.feature_id for r in features.pair_table(atoms).collect())
    assert ids == list(range(45))
    short = spark.createDataFrame([(1,), (1,), (4,)], "atom int")
    assert features.pair_list(features.pair_table(short)) == [(1, 4)]
    assert features.pair_list(features.pair_table(short.limit(1))) == []


def test_distance_by_hand(spark):
    xyz = [15.96, 24.60, 14.91, 15.17, 24.26, 13.66]
    frames = spark.createDataFrame([(0, 0, xyz)], "traj_id int, frame bigint, xyz array<double>")
    assert features.pair_distances(frames, [(0, 1)]).first().x == [pytest.approx(np.sqrt(2.3022))]
    inverse = features.pair_distances(frames, [(0, 1)], exponent=-2.0).first().x
    assert inverse == [pytest.approx(1 / 2.3022)]
    long = features.unpack_coordinates(frames)
    assert [r.x for r in long.orderBy("atom").collect()] == [15.96, 15.17]
    assert features.pack_coordinates(long).first().xyz == xyz
    assert features.distances_long(long, [(0, 1)]).first().d == pytest.approx(np.sqrt(2.3022))


def test_null_vector_is_reported(spark):
    frames = spark.createDataFrame([(0, 0, None)], "traj_id int, frame bigint, xyz array<double>")
    with pytest.raises(Exception, match="NULL"):
        features.pair_distances(frames, [(0, 1)]).collect()


@pytest.fixture(scope="module")
def walk(spark):
    """Five slow and fast mixed signals; one trajectory is much longer."""
    rng = np.random.default_rng(11)
    rows, trajs = [], []
    for t, size in enumerate([400, 40, 3, 60]):
        slow = np.zeros((size, 5))
        for f in range(1, size):
            slow[f] = slow[f - 1] * [0.95, 0.8, 0.5, 0.2, 0.0] + rng.normal(size=5)
        x = slow @ MIX + 3.0
        trajs.append(x)
        rows += [(t, f, x[f].tolist()) for f in range(size)]
    df = spark.createDataFrame(rows, "traj_id int, frame bigint, x array<double>").repartition(6)
    return df.cache(), trajs


MIX = np.array([[1., .4, -.3, .2, 0.], [.1, 1., .5, -.2, .3], [0., .2, 1., .6, -.1],
                [.3, -.1, .2, 1., .4], [-.2, .3, 0., .1, 1.]])


def numpy_moments(trajs, lag):
    x = np.vstack([t[:-lag] for t in trajs if len(t) > lag])
    y = np.vstack([t[lag:] for t in trajs if len(t) > lag])
    mean = (x.sum(0) + y.sum(0)) / (2 * len(x))
    a, b = x - mean, y - mean
    return len(x), mean, (a.T @ a + b.T @ b) / (2 * len(x)), (a.T @ b + b.T @ a) / (2 * len(x))


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_moments(walk, chunk):
    df, trajs = walk
    got = covariance.lagged_moments(df, [1, 4], chunk_rows=chunk).toPandas()
    for lag in (1, 4):
        m = covariance.assemble(got[got.lag == lag])
        n, mean, c0, ct = numpy_moments(trajs, lag)
        assert m.n == n and np.allclose(m.mean, mean)
        assert np.allclose(m.cov, c0) and np.allclose(m.lagged, ct)


def test_tica(walk, spark):
    df, trajs = walk
    model = tica.fit_tica(df, 4, 3)
    _, mean, c0, ct = numpy_moments(trajs, 4)
    lam = np.sort(np.linalg.eigvals(np.linalg.solve(c0, ct)).real)[::-1]
    assert np.allclose(model.eigenvalues, lam[:3])
    assert np.allclose(model.vectors.T @ c0 @ model.vectors, np.eye(3), atol=1e-9)
    y = {(r.traj_id, r.frame): r.y for r in model.transform(df).collect()}
    expect = (trajs[1][7] - mean) @ model.vectors * model.eigenvalues
    assert np.allclose(y[(1, 7)], expect)
    plain = tica.fit_tica(df, 4, 3, kinetic_mapping=False).transform(df)
    all_y = np.array([r.y for r in plain.collect()])
    assert abs(all_y.std(0) - 1).max() < 0.2
    kept = tica.TicaModel.from_table(model.table(spark))
    assert np.allclose(kept.vectors, model.vectors) and kept.lag == 4
    times = {r.k: r.t for r in tica.tica_timescales(covariance.lagged_moments(df, [4]), 2).collect()}
    assert times[0] == pytest.approx(-4 / np.log(lam[0]))


def test_tica_without_pairs(walk):
    with pytest.raises(ValueError):
        tica.fit_tica(walk[0], 1000)


def test_shrinkage():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6))
    cov = np.cov(x.T)
    small = covariance.shrink(cov, 30)
    assert np.trace(small) == pytest.approx(np.trace(cov))
    assert np.linalg.cond(small) < np.linalg.cond(cov)
    assert np.allclose(covariance.shrink(cov, 10 ** 9), cov, rtol=1e-4, atol=1e-6)


def test_rank_deficient_features(spark, walk):
    df, _ = walk
    double = df.withColumn("x", F.concat("x", F.array(F.col("x")[0] * 2)))
    a = tica.fit_tica(df, 2, 5).eigenvalues
    with pytest.raises(ValueError, match="span 5"):
        tica.fit_tica(double, 2, 6)
    b = tica.fit_tica(double, 2, 6, allow_fewer=True).eigenvalues
    assert len(b) == 5 and np.allclose(a, b, atol=1e-6)


def test_feature_selection(walk):
    df, trajs = walk
    rows = tica.select_features(covariance.lagged_moments(df, [2]), [1, 3, 5], seed=1).collect()
    by = {n: [r.feature_id for r in sorted(rows, key=lambda r: r.rank) if r.n_cols == n] for n in (1, 3, 5)}
    assert by[3][:1] == by[1] and by[5][:3] == by[3]
    assert sorted(by[5]) == [0, 1, 2, 3, 4]
    t = {r.n_cols: r.t for r in rows}
    assert t[1] <= t[3] + 1e-9 <= t[5] + 2e-9     # more columns never lose the slowest process
    full = tica.tica_timescales(covariance.lagged_moments(df, [2]), 1).collect()[0].t
    assert t[5] == pytest.approx(full)
    again = tica.select_features(covariance.lagged_moments(df, [2]), [3], seed=1).collect()
    assert [r.feature_id for r in sorted(again, key=lambda r: r.rank)] == by[3]


def selected_by_hand(g, n_cols, first):
    """The published form: a pseudo-inverse of the chosen block for every column."""
    chosen = [first]
    while len(chosen) < n_cols:
        approx = g[:, chosen] @ np.linalg.pinv(g[np.ix_(chosen, chosen)]) @ g[chosen]
        lam, u = np.linalg.eigh((approx + approx.T) / 2)
        gain = np.abs(np.diag(g - approx)) * np.abs(u[:, np.abs(lam).argmax()])
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
    return chosen


def test_rank_one_updates_equal_pseudo_inverses():
    rng = np.random.default_rng(8)
    for d in (3, 12, 45):
        for definite in (True, False):
            a = rng.normal(size=(d, d))
            g = a @ a.T if definite else a + a.T
            g = g / np.sqrt(np.outer(abs(np.diag(g)), abs(np.diag(g))))
            got = tica.greedy_columns(g, np.eye(d), min(d, 28), 1)
            assert got == selected_by_hand(g, min(d, 28), 1)


def test_columns_that_others_explain_come_last():
    a = np.random.default_rng(1).normal(size=(6, 6))
    a[4], a[5] = a[0], 0
    got = tica.greedy_columns(a @ a.T, np.eye(6), 6, 0)
    assert sorted(got) == list(range(6)) and got[4:] == [4, 5]


def test_more_columns_than_there_are(spark, walk):
    moments = covariance.lagged_moments(walk[0], [2])
    with pytest.raises(Exception, match="asked for"):
        tica.select_features(moments, [4, 9]).collect()
    rows = tica.select_features(moments, [4, 9], allow_fewer=True).collect()
    assert {r.n_cols for r in rows} == {4, 5}
    with pytest.raises(Exception, match="span 5"):
        tica.tica_timescales(moments, 6).collect()
    assert tica.tica_timescales(moments, 6, allow_fewer=True).count() == 5
    starts = spark.range(1, 9).select("id", tica.start_column_of(F.lit(3), F.col("id"), 45).alias("c")).collect()
    assert all(r.c == tica.start_column(3, r.id, 45) for r in starts)


def test_several_columns_per_round():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 12))
    g = a @ a.T
    one = tica.greedy_columns(g, g, 6, 0, 1)
    four = tica.greedy_columns(g, g, 6, 0, 4)
    assert len(set(one)) == len(set(four)) == 6 and one[0] == four[0] == 0


# -- clustering ----------------------------------------------------------------------------

def farthest_points(y, keys, k, first):
    order = sorted(range(len(y)), key=lambda p: keys[p])
    y = y[order]
    at = [keys[p] for p in order].index(first)
    chosen, d = [at], np.linalg.norm(y - y[at], axis=1)
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(y - y[chosen[-1]], axis=1))
    return [keys[order[c]] for c in chosen]


@pytest.mark.parametrize("pool", [3, 40, 4096])
def test_k_centers_is_exact(spark, monkeypatch, pool):
    monkeypatch.setattr(clustering, "POOL_ROWS", pool)
    monkeypatch.setattr(clustering, "CUT_EVERY", 4)
    rng = np.random.default_rng(6)
    y = rng.normal(size=(600, 3))
    keys = [(k % 4, k // 4) for k in range(600)]
    df = spark.createDataFrame([(a, b, v.tolist()) for (a, b), v in zip(keys, y)],
                               "traj_id int, frame bigint, y array<double>").repartition(5)
    got = clustering.k_centers(df, 25, first=(2, 3))
    assert got.keys == farthest_points(y, keys, 25, (2, 3))
    d = np.linalg.norm(y[:, None] - got.centers[None], axis=2)
    for r in got.assigned.collect():
        at = keys.index((r.traj_id, r.frame))
        assert r.state == d[at].argmin() and r.distance == pytest.approx(d[at].min())
    other = clustering.assign_nearest(df, got.centers)
    assert sorted(map(tuple, other.collect())) == sorted(
        (r.traj_id, r.frame, r.distance, r.state) for r in got.assigned.collect())


def test_k_centers_with_ties_and_few_distinct_points(spark):
    rows = [(0, f, [float(f % 3), 0.0]) for f in range(30)]
    df = spark.createDataFrame(rows, "traj_id int, frame bigint, y array<double>")
    got = clustering.k_centers(df, 10, first=(0, 0))
    assert got.keys == [(0, 0), (0, 2), (0, 1)]
    assert got.assigned.agg(F.max("distance")).first()[0] == 0.0
    with pytest.raises(ValueError):
        clustering.k_centers(df, 0)
    with pytest.raises(ValueError):
        clustering.k_centers(df.limit(0), 2)


def test_sweep_runs_equal_settings_once(spark):
    grid = spark.createDataFrame([("a", 1, 1, 5), ("b", 5, 1, 5), ("b", 6, 1, 6)],
                                 "parameter string, value int, x int, y int")
    calls = []
    out = clustering.sweep(grid, lambda x, y: calls.append((x, y)) or x + y)
    assert sorted(calls) == [(1, 5), (1, 6)]
    assert out == {("a", 1): 6, ("b", 5): 6, ("b", 6): 7}


# -- sampling ------------------------------------------------------------------------------

def test_sampling(spark):
    rows = [(f % 3, f, "big" if f < 950 else "small") for f in range(953)]
    df = spark.createDataFrame(rows, "traj_id int, frame bigint, state string")
    a = sampling.sample_states(df, 10, seed=1)
    assert a.groupBy("state").count().where("count <> 10").count() == 0
    assert sorted(map(tuple, a.collect())) == sorted(
        map(tuple, sampling.sample_states(df.repartition(7), 10, seed=1).collect()))
    assert sorted(map(tuple, a.collect())) != sorted(
        map(tuple, sampling.sample_states(df, 10, seed=2).collect()))
    kept = df.join(a.select("traj_id", "frame", "state").distinct(), ["traj_id", "frame", "state"])
    assert kept.count() == a.select("traj_id", "frame").distinct().count()
    once = sampling.sample_states(df, 10, replace=False).collect()
    assert sum(r.state == "small" for r in once) == 3
    assert len({(r.traj_id, r.frame) for r in once}) == 13
    with pytest.raises(ValueError):
        sampling.sample_states(df, 0)


def test_sampling_is_uniform(spark):
    df = spark.createDataFrame([(0, f, 0) for f in range(20)], "traj_id int, frame bigint, state int")
    n = np.bincount([r.frame for r in sampling.sample_states(df, 2000).collect()], minlength=20)
    assert n.sum() == 2000 and n.min() > 55 and n.max() < 150


def test_sampled_structures_and_manifest(spark):
    frames = spark.createDataFrame([(0, f, [float(f)] * 6) for f in range(9)],
                                   "traj_id int, frame bigint, xyz array<double>")
    picks = spark.createDataFrame([(3, 0, 0, 4), (3, 1, 0, 4)],
                                  "state int, sample_no int, traj_id int, frame bigint")
    got = sampling.sampled_structures(frames, picks).collect()
    assert len(got) == 2 and all(r.xyz[0] == 4.0 for r in got)
    assert [r.output_filename for r in sampling.manifest(picks).orderBy("output_filename").collect()
            ] == ["macro3_sample0.pdb", "macro3_sample1.pdb"]


def test_reversible_fit_of_tree_counts_is_row_normalisation():
    """Slow exchange along a chain: no cycle, so detailed balance binds nothing."""
    from tauframe.functions import dense

    counts = np.array([[1e6, 1, 0], [3, 1e6, 2], [0, 1, 1e6]])
    flux = dense.fit_reversible(counts)
    assert np.allclose(flux, flux.T, rtol=1e-12, atol=0)
    got, want = flux / flux.sum(1, keepdims=True), counts / counts.sum(1, keepdims=True)
    assert np.allclose(got[counts > 0], want[counts > 0], rtol=1e-9, atol=0)
    with pytest.raises(ValueError, match="one direction"):
        dense.fit_reversible(np.array([[5.0, 1.0], [0.0, 5.0]]))


def test_ragged_and_null_vectors_are_errors():
    import pyarrow as pa

    from tauframe.functions.arrays import matrix_of

    for rows in ([[1.0, 2.0], [3.0, 4.0, 5.0, 6.0]], [[1.0, None], [2.0, 3.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            matrix_of(pa.array(rows, pa.list_(pa.float64())))
    assert matrix_of(pa.array([[1.0, 2.0], [3.0, 4.0]]).slice(1)).tolist() == [[3.0, 4.0]]


def test_lags_without_pairs_are_an_error(spark):
    from tauframe.operators import series

    d = spark.createDataFrame([(1, f, f % 2) for f in range(6)], "traj_id int, frame bigint, state int")
    assert series.matrix_series(d, 4).count() > 0
    with pytest.raises(Exception, match="no pair of frames"):
        series.matrix_series(d, 10).collect()


def test_points_that_are_not_finite_are_an_error(spark):
    from tauframe.operators import clustering

    points = spark.createDataFrame([(1, 0, [0.0, float("nan")]), (1, 1, [1.0, 2.0])],
                                   "traj_id int, frame bigint, y array<double>")
    with pytest.raises(Exception, match="not finite"):
        clustering.k_centers(points, 2)


def test_far_off_means_keep_the_digits(spark, walk):
    df, trajs = walk
    moved = df.withColumn("x", F.transform("x", lambda v: v + 1e8))
    a, b = tica.fit_tica(df, 2, 3), tica.fit_tica(moved, 2, 3)
    assert np.allclose(a.eigenvalues, b.eigenvalues, atol=1e-6)
    assert np.allclose(a.mean + 1e8, b.mean, rtol=1e-12)
    m = covariance.assemble(covariance.lagged_moments(moved, [2], chunk_rows=16).toPandas())
    _, mean, c0, ct = numpy_moments(trajs, 2)
    assert np.allclose(m.cov, c0, atol=1e-6) and np.allclose(m.lagged, ct, atol=1e-6)


def test_partial_moments_add_up_in_any_order():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(2, 90, 4)) + 1e8
    whole = covariance.Partial.of(x, y)
    cuts = [0, 1, 2, 30, 90]
    parts = [covariance.Partial.of(x[a:b], y[a:b]) for a, b in zip(cuts, cuts[1:])]
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        got = parts[order[0]]
        for k in order[1:]:
            got = got + parts[k]
        assert got.n == 90
        for name in ("mx", "my", "same", "cross"):
            assert np.allclose(getattr(got, name), getattr(whole, name), atol=1e-5, rtol=1e-12)
    e = x - x.mean(0)
    assert np.allclose(whole.same, e.T @ e + (y - y.mean(0)).T @ (y - y.mean(0)), atol=1e-5)


def test_sampling_reads_ranks_not_copies(spark, monkeypatch):
    rows = [(f % 3, f, f % 2) for f in range(400)]
    df = spark.createDataFrame(rows, "traj_id int, frame bigint, state int")
    got = sampling.sample_states(df, 1000, seed=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    want = sorted(map(tuple, got.collect()))
    assert len(want) == 2000 and len({r[1] for r in want}) == 1000
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 1)      # deeper buckets, same ranks
    monkeypatch.setattr(sampling, "DIGITS", 1)
    assert sorted(map(tuple, sampling.sample_states(df, 1000, seed=4).collect())) == want
    assert sampling.sample_states(df.where("false"), 5).count() == 0


# -- trimming over lags --------------------------------------------------------------------

def test_states_without_a_way_back_are_trimmed(spark):
    from tauframe.operators import counting, series

    path = [0, 1, 0, 2, 1, 2, 0, 0, 1, 1, 2, 0, 1]
    rows = [("m", 0, f, s) for f, s in enumerate([7, *path, 9])] + [("n", 0, f, s) for f, s in enumerate(path)]
    df = spark.createDataFrame(rows, "model string, traj_id int, frame bigint, state int")
    with pytest.raises(Exception, match="one direction"):
        series.matrix_series(df, 2, reversible="mle", keys=["model"]).collect()
    got = series.matrix_series(df, 2, reversible="mle", keys=["model"], trim=True).collect()
    assert len(got) == 2 * 2 * 9
    by = {m: {(r.k, r.i, r.j): r.p for r in got if r.model == m} for m in "mn"}
    assert all(by["m"][c] == pytest.approx(by["n"][c]) for c in by["n"])
    counts = counting.count_transitions(df, [1, 2], keys=["model"], traj=["model", "traj_id"])
    kept = reversible.common_states(counts, ["model"])
    lost = reversible.trimmed_states(counts, kept, ["model"]).collect()
    assert {(r.model, r.lag, r.state, r.n) for r in lost} == {("m", lag, s, 1) for lag in (1, 2) for s in (7, 9)}


def test_what_one_lag_loses_may_cut_another(spark):
    """At lag 2 state 3 goes; at lag 1 it is the only bridge from 0, 1 to 4."""
    rows = [(1, 0, 1, 9), (1, 1, 0, 9), (1, 1, 3, 5), (1, 3, 4, 5), (1, 4, 3, 5), (1, 3, 1, 5),
            (2, 0, 1, 9), (2, 1, 0, 9), (2, 1, 4, 5), (2, 4, 1, 5), (2, 3, 4, 2)]
    counts = spark.createDataFrame(rows, "lag int, i int, j int, n bigint")
    assert {r.state for r in reversible.common_states(counts).collect()} == {0, 1}
    apart = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 0, 1), (2, 2, 3, 1), (2, 3, 2, 1)], "lag int, i int, j int, n bigint")
    with pytest.raises(ValueError, match="every lag"):
        reversible.common_states(apart)


def test_absent_cells_are_zeros_per_model(spark):
    from tauframe.operators import series

    rows = [("a", 0, "x", "y", 1.0), ("a", 1, "y", "x", 0.5), (None, 0, "z", "z", 1.0), (None, 1, "z", "z", 1.0)]
    df = spark.createDataFrame(rows, "model string, k int, i string, j string, p double")
    got = {(r.model, r.k, r.i, r.j): r.p for r in series.fill_cells(df, ["model"], 2).collect()}
    assert len(got) == 8 + 2 and got["a", 0, "x", "y"] == 1.0 and got["a", 1, "x", "x"] == 0.0 and got[None, 1, "z", "z"] == 1.0
    with pytest.raises(Exception, match="lag steps 2"):
        series.fill_cells(df, ["model"], 3).collect()
    assert series.fill_cells(df.where("false"), [], 3).count() == 0
