"""Several clusterings in one series of passes, and settings compared by their scores."""

import numpy as np
import pytest

from tauframe.operators import clustering, spectrum, tica
from tauframe.operators.many_centers import Run, k_centers_many
from tauframe.plans import settings, sweep
from tauframe.operators import covariance


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    y, z = rng.normal(size=(500, 3)), rng.normal(size=(500, 2))
    rows = [(k % 4, k // 4, y[k].tolist(), z[k].tolist()) for k in range(500)]
    return spark.createDataFrame(rows, "traj_id int, frame bigint, y array<double>, z array<double>").repartition(5)


@pytest.mark.parametrize("pool", [12, 20_000])
def test_runs_together_equal_runs_alone(points, monkeypatch, pool):
    monkeypatch.setattr(clustering, "POOL_ROWS", pool)
    monkeypatch.setattr(clustering, "CUT_EVERY", 3)
    runs = {"a": Run("y", 3, 20), "b": Run("y", 2, 7), "c": Run("z", 2, 11), "d": Run("y", 3, 1), "e": Run("y", 3, 20)}
    made = k_centers_many(points, runs)
    got = {}
    for r in made.assigned.collect():
        got.setdefault(r.run_id, set()).add((r.traj_id, r.frame, r.state, r.distance))
    for name, run in runs.items():
        alone = clustering.k_centers(points.selectExpr("traj_id", "frame", f"slice({run.column}, 1, {run.width}) AS y"), run.k)
        assert made.keys[name] == alone.keys and np.array_equal(made.centers[name], alone.centers)
        assert got[name] == {(r.traj_id, r.frame, r.state, r.distance) for r in alone.assigned.collect()}
    if pool == 20_000:
        assert made.passes == 2      # one for the first center, one for all others of all runs


def test_few_distinct_points_and_bad_settings(spark, points):
    rows = [(0, f, [float(f % 3), 0.0]) for f in range(30)]
    few = spark.createDataFrame(rows, "traj_id int, frame bigint, y array<double>")
    made = k_centers_many(few, {"a": Run("y", 2, 10), "b": Run("y", 1, 2)})
    assert len(made.keys["a"]) == 3 and len(made.keys["b"]) == 2
    for bad in ({}, {"a": Run("y", 2, 0)}):
        with pytest.raises(ValueError):
            k_centers_many(few, bad)
    with pytest.raises(ValueError):
        k_centers_many(few.where("false"), {"a": Run("y", 2, 2)})


def test_settings_are_scored_once_each(spark):
    rng = np.random.default_rng(3)
    rows = []
    for t in range(8):
        x = np.zeros((60, 6))
        for f in range(1, 60):
            x[f] = x[f - 1] * [0.95, 0.9, 0.7, 0.4, 0.2, 0.0] + rng.normal(size=6)
        rows += [(t, f, x[f].tolist()) for f in range(60)]
    x = spark.createDataFrame(rows, "traj_id int, frame bigint, x array<double>").repartition(4).cache()
    grid = settings.one_at_a_time(
        spark, {"no_features": 5, "no_components": 2, "no_clusters": 5, "tica_lagtime": 1},
        {"no_features": [4, 5], "no_components": [2, 3], "no_clusters": [4, 5], "tica_lagtime": [1, 2]})
    made = sweep.score_settings(x, grid, lag=1, repeats=2, folds=4, n_timescales=1)
    assert len(made.found.keys) == 5
    summary = {(r.parameter, r.value): r for r in made.summary.collect()}
    assert len(summary) == 8 and all(r.n_scores == 8 for r in summary.values())
    same = [summary[k] for k in (("no_features", 5), ("no_components", 2), ("no_clusters", 5), ("tica_lagtime", 1))]
    assert len({(r.run_id, r.test_median, r.train_mean) for r in same}) == 1
    # one setting by the operators one after the other
    moments = covariance.lagged_moments(x, [2])
    columns = [r.feature_id for r in tica.select_features(moments, [5]).orderBy("rank").collect()]
    part = x.selectExpr("traj_id", "frame", f"array({', '.join(f'x[{c}]' for c in columns)}) AS x")
    y = tica.fit_tica(part, 2, 2).transform(part)
    alone = clustering.k_centers(y, 5).assigned.select("traj_id", "frame", "state")
    want = spectrum.score_summary(spectrum.cross_validate(alone, 1, 2, 4, 1)).first()
    got = summary["tica_lagtime", 2]
    assert got.test_median == pytest.approx(want.test_median) and got.train_mean == pytest.approx(want.train_mean)
