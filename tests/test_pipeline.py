"""The whole chain on simulated data, and properties of its plans."""

import numpy as np
import pytest

from tauframe.operators import counting, features, memory, sampling, spectrum
from tauframe.plans import catalog, pipeline


@pytest.fixture(scope="module")
def simulated(spark):
    """Points jumping between four wells; three slow exits, read as 3 atoms in space."""
    rng = np.random.default_rng(21)
    t = np.full((4, 4), 0.01) + np.eye(4) * 0.96
    wells = rng.normal(size=(4, 9)) * 4
    rows, truth = [], {}
    for traj in range(8):
        s = traj % 4
        for f in range(500):
            s = rng.choice(4, p=t[s])
            truth[(traj, f)] = s
            rows.append((traj, f, (wells[s] + rng.normal(size=9) * 0.3).tolist()))
    df = spark.createDataFrame(rows, "traj_id int, frame bigint, xyz array<double>")
    return df.repartition(4).cache(), truth, t


def test_chain(simulated, spark):
    frames, truth, t = simulated
    x = features.pair_distances(frames, [(0, 1), (0, 2), (1, 2)])
    micro = pipeline.discretise(x, lag=1, n_components=3, n_clusters=30)
    assert micro.select("state").distinct().count() == 30
    model = pipeline.macro_model(micro, 1, 4, 15, 1.0, 10)
    found = {(r.traj_id, r.frame): r.state for r in model.macro.collect()}
    # each well is one macrostate
    name = {}
    for key, state in found.items():
        name.setdefault(truth[key], []).append(state)
    best = {w: np.bincount(s).argmax() for w, s in name.items()}
    assert len(set(best.values())) == 4
    right = np.mean([best[truth[k]] == s for k, s in found.items()])
    assert right > 0.98
    rows = model.series.where("k = 0").collect()
    stay = {r.i: r.p for r in rows if r.i == r.j}
    assert all(abs(p - 0.97) < 0.03 for p in stay.values())
    pred = memory.predict_memory(model.series, model.kernel, 1.0, 3, 12).collect()
    sums = {}
    for r in pred:
        sums[(r.idx, r.i)] = sums.get((r.idx, r.i), 0) + r.p
    assert np.allclose(list(sums.values()), 1)
    its = spectrum.bootstrap_timescales(model.macro, [1, 2], 5, 3, seed=4)
    assert its.count() == 5 * 2 * 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_scan_only_what_they_need(spark):
    df = catalog.transition_counts(spark, "/root/testdata/sf0.001")
    text = plan(df)
    read = [line for line in text.splitlines() if "ReadSchema" in line]
    assert read and all("props" not in line and "value" not in line for line in read)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_one_shuffle_for_many_lags(spark):
    rows = [(k % 3, k // 3, k % 4) for k in range(90)]
    d = spark.createDataFrame(rows, "traj_id int, frame bigint, state int")
    few = plan(counting.count_transitions(d, [1], method="window")).count("Exchange hash")
    many = plan(counting.count_transitions(d, range(1, 9), method="window")).count("Exchange hash")
    sweep = plan(counting.count_transitions(d, range(1, 60))).count("Exchange ")
    assert few == many == 2 and sweep == 2


def test_lumping_map_does_not_shuffle_frames_by_state(spark):
    df = catalog.macrostate_map(spark, "/root/testdata/sf0.001")
    text = plan(df)
    assert "BroadcastHashJoin" in text and "hashpartitioning(state" not in text


def test_null_keys_are_filtered_in_the_scan(spark):
    text = plan(catalog.transition_counts(spark, "/root/testdata/sf0.001"))
    assert "IsNotNull(user_id)" in text and "IsNotNull(ts)" in text


def test_sampled_structures_do_not_shuffle_coordinates(spark, tmp_path):
    spark.range(200).selectExpr("0 as traj_id", "id as frame", "array(1.0D, 2.0D, 3.0D) as xyz"
                                ).write.parquet(str(tmp_path / "f"))
    frames = spark.read.parquet(str(tmp_path / "f"))
    states = frames.selectExpr("traj_id", "frame", "frame % 3 as state")
    got = sampling.sampled_structures(frames, sampling.sample_states(states, 2))
    assert "Exchange hash" not in plan(got) and got.count() == 6
    wanted = sampling.sample_states(states, 2)
    assert sampling.pick_frames(frames, wanted).count() == wanted.select("frame").distinct().count()
