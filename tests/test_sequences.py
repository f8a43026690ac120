"""Ordering, lagging and counting: hand-worked cases, and agreement of all plan shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tauframe.operators import counting, sequences, spectrum
from tauframe.plans import settings

TWO = [("A", 0, 0), ("A", 1, 0), ("A", 2, 1), ("B", 0, 1), ("B", 1, 0)]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(TWO, "traj_id string, frame bigint, state int")


@pytest.fixture(scope="module")
def skewed(spark):
    """One trajectory holds most rows; frames are missing here and there."""
    rng = np.random.default_rng(3)
    rows = [(0, f, f"s{rng.integers(5)}") for f in range(700) if f % 13 != 5]
    rows += [(t, f, f"s{rng.integers(5)}") for t in range(1, 12) for f in range(int(rng.integers(1, 30)))]
    return spark.createDataFrame(rows, "traj_id int, frame bigint, state string").repartition(5)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def brute_counts(rows, lags):
    at = {(t, f): s for t, f, s in rows}
    out = {}
    for (t, f), s in at.items():
        for lag in lags:
            if (t, f + lag) in at:
                key = (lag, s, at[(t, f + lag)])
                out[key] = out.get(key, 0) + 1
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize("method", ["window", "arrow"])
def test_counts_do_not_cross_trajectories(two, method):
    counts = counting.count_transitions(two, [1], method=method)
    assert got(counts) == [(1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 0, 1)]


@pytest.mark.parametrize("method", ["window", "arrow"])
def test_lag_longer_than_trajectories(two, method):
    assert got(counting.count_transitions(two, [3], method=method)) == []


def test_tpm_and_transpose(two):
    counts = counting.count_transitions(two, [1])
    tpm = {(r.i, r.j): r.p for r in counting.transition_matrix(counts).collect()}
    assert tpm == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 1.0}
    sym = counting.symmetrise(counts)
    assert {(r.i, r.j): r.n for r in sym.collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 1}
    pops = {r.i: r.p for r in counting.populations(sym).collect()}
    assert pops == pytest.approx({0: 2 / 3, 1: 1 / 3})


@pytest.mark.parametrize("method", ["window", "arrow"])
@pytest.mark.parametrize("chunk", [8, 40, 1 << 16])
def test_chunking_and_gaps(skewed, method, chunk):
    rows = [tuple(r) for r in skewed.collect()]
    lags = [1, 2, 7, 10]
    counts = counting.count_transitions(skewed, lags, method=method, chunk_rows=chunk)
    assert got(counts) == brute_counts(rows, lags)


def test_small_arrow_batches(spark, skewed):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        counts = counting.count_transitions(skewed, [1, 5, 12], method="arrow", keys=["traj_id"])
        total = counts.groupBy("lag", "i", "j").agg(F.sum("n").alias("n"))
        assert got(total) == brute_counts([tuple(r) for r in skewed.collect()], [1, 5, 12])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_null_states_make_no_pairs(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, None), (0, 2, "b"), (0, 3, "a")],
                               "traj_id int, frame bigint, state string")
    for method in ("window", "arrow"):
        assert got(counting.count_transitions(df, [1, 2], method=method)) == [
            (1, "b", "a", 1), (2, "a", "b", 1)]


@pytest.mark.parametrize("bad", [[], [0], [-1, 2]])
def test_bad_lags(two, bad):
    with pytest.raises(ValueError):
        counting.count_transitions(two, bad)


def test_unknown_choices(two):
    counts = counting.count_transitions(two, [1])
    with pytest.raises(ValueError):
        counting.transition_matrix(counts, reversible="other")
    with pytest.raises(ValueError):
        counting.count_transitions(two, [1], method="other")
    with pytest.raises(ValueError):
        sequences.every_nth(two, 0)


@pytest.mark.parametrize("kind", ["bigint", "timestamp", "timestamp_ntz", "date"])
def test_split_index_equals_plain(spark, kind):
    rng = np.random.default_rng(1)
    raw = [(0 if k < 600 else int(rng.integers(1, 20)), int(rng.integers(0, 50)), k)
           for k in range(900)]
    df = spark.createDataFrame(raw, "user int, t bigint, id bigint")
    moment = F.timestamp_seconds(F.col("t") * 86400)
    order = {"bigint": F.col("t"), "timestamp": moment, "timestamp_ntz": moment.cast("timestamp_ntz"),
             "date": moment.cast("date")}[kind]
    df = df.withColumn("t", order)
    plain = sequences.index_frames(df, "user", ["t", "id"], ["id"], hot_rows=None)
    split = sequences.index_frames(df, "user", ["t", "id"], ["id"], hot_rows=30)
    assert got(plain) == got(split)
    assert "_cell" in split._jdf.queryExecution().analyzed().toString()


def test_many_small_cells_share_partitions(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(sequences, "materialise", lambda df, label: saved.append(df) or df.persist())
    df = spark.range(3000).selectExpr("id % 7 as user", "(id * 7919) % 3000 as t", "id")
    frames = got(sequences.index_frames(df, "user", ["t"], ["id"], hot_rows=10))
    assert frames == got(sequences.index_frames(df, "user", ["t"], ["id"], hot_rows=None))
    assert saved[0].rdd.getNumPartitions() <= 4          # the session's shuffle partitions
    sizes = [r["count"] for r in saved[0].groupBy("_cell").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 10 and len(sizes) < 300 + 4
    saved[0].unpersist()


@pytest.mark.parametrize("kind", ["outlier", "ties", "tiny range", "strings", "all equal"])
def test_cells_are_of_like_size(spark, kind):
    key = {"outlier": lambda k: 10.0 ** 12 if k == 0 else float(k), "ties": lambda k: float(k % 2),
           "tiny range": lambda k: k * 1e-9, "strings": lambda k: f"key{k:05d}", "all equal": lambda k: 1.0}[kind]
    df = spark.createDataFrame([(7, key(k), k) for k in range(4000)],
                               f"user int, t {'string' if kind == 'strings' else 'double'}, id bigint")
    order = ["t"] if kind == "all equal" else ["t", "id"]
    sizes = [r["count"] for r in sequences.cells(df, "user", order, ["id"], 20).groupBy("_cell").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 200
    frames = got(sequences.index_frames(df, "user", order, ["id"], hot_rows=200))
    if kind == "all equal":
        assert sorted(f for _, f, _ in frames) == list(range(4000))
    else:
        assert frames == got(sequences.index_frames(df, "user", order, ["id"], hot_rows=None))


def test_small_tables_are_ranked_without_a_job(spark):
    df = spark.range(1000).selectExpr("id % 10 as u", "id as t")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    sequences.index_frames(df, "u", ["t"], [])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def test_index_leaves_out_missing_keys(spark):
    df = spark.createDataFrame([(1, 5, "a"), (None, 6, "b"), (1, None, "c"), (1, 2, "d")],
                               "u int, t int, v string")
    assert got(sequences.index_frames(df, "u", ["t"], ["v"])) == [(1, 0, "d"), (1, 1, "a")]


def test_bucketed_rank_equals_plain(spark, monkeypatch):
    df = spark.range(500).withColumnRenamed("id", "traj_id")
    plain = got(spectrum.number_trajectories(df).select("idx", "traj_id"))
    folds = got(spectrum.assign_folds(df, 2, 7))
    monkeypatch.setattr(sequences, "RANK_ROWS", 10)
    assert got(spectrum.number_trajectories(df).select("idx", "traj_id")) == plain
    assert got(spectrum.assign_folds(df, 2, 7)) == folds
    assert [p[0] for p in plain] == list(range(500))


def test_folds_are_balanced_and_differ(spark):
    df = spark.range(100).withColumnRenamed("id", "traj_id")
    rows = spectrum.assign_folds(df, 3, 6).collect()
    for repeat in range(3):
        sizes = np.bincount([r.fold for r in rows if r.repeat == repeat])
        assert sorted(sizes) == [16, 16, 17, 17, 17, 17]
    by = [{r.traj_id: r.fold for r in rows if r.repeat == k} for k in range(2)]
    assert by[0] != by[1]


def test_more_folds_than_trajectories(spark):
    df = spark.range(3).withColumnRenamed("id", "traj_id")
    assert sorted(r.fold for r in spectrum.assign_folds(df, 1, 6).collect()) == [0, 1, 2]


def test_bootstrap_is_a_weighted_recount(skewed):
    draws = spectrum.bootstrap_draws(spectrum.number_trajectories(skewed), 4, seed=2)
    weight = {(r.boot_id, r.traj_id): r.weight for r in draws.collect()}
    per_boot = {b: sum(w for (x, _), w in weight.items() if x == b) for b in range(4)}
    assert set(per_boot.values()) == {12}
    rows = [tuple(r) for r in skewed.collect()]
    counts = got(spectrum.bootstrap_counts(skewed, [1, 3], draws))
    expect = []
    for b in range(4):
        again = []
        for t in range(12):
            for copy in range(weight.get((b, t), 0)):
                again += [((t, copy), f, s) for tt, f, s in rows if tt == t]
        expect += [(b, *c) for c in brute_counts(again, [1, 3])]
    assert counts == sorted(expect)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast(skewed):
    numbered = spectrum.number_trajectories(skewed)
    draws = spectrum.bootstrap_draws(numbered, 4)
    for df in (draws, spectrum.bootstrap_counts(skewed, [1, 3], draws), spectrum.bootstrap_timescales(skewed, [1, 3], 4)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_summary_of_resamples_sends_no_draws_around(skewed):
    its = spectrum.bootstrap_timescales(skewed, [1, 3], 4, 2)
    summary = spectrum.timescale_summary(its)
    assert "Broadcast" not in plan(summary)
    assert [(r.lag, r.k, r.n_finite) for r in summary.orderBy("lag", "k").collect()] == [
        (lag, k, its.where(f"lag = {lag} and k = {k} and t is not null").count()) for lag in (1, 3) for k in (0, 1)]


def test_fold_counts_add_up(skewed):
    assigned = spectrum.assign_folds(skewed, 2, 3)
    rows = spectrum.fold_counts(skewed, 1, assigned, 3).collect()
    whole = dict(((i, j), n) for _, i, j, n in brute_counts([tuple(r) for r in skewed.collect()], [1]))
    for repeat in range(2):
        for (i, j), n in whole.items():
            cell = [r for r in rows if (r.repeat, r.i, r.j) == (repeat, i, j)]
            assert {r.n_test + r.n_train for r in cell} == {n}
            assert sum(r.n_test for r in cell) == n and len(cell) == 3


def test_settings_share_the_baseline(spark):
    grid = settings.one_at_a_time(spark)
    assert grid.count() == 12
    assert grid.select("run_id").distinct().count() == 9
    reordered = dict(reversed(list(settings.CLUSTER_SWEEP.items())))
    again = settings.one_at_a_time(spark, axes=reordered)
    assert got(grid) == got(again)


def test_parameter_product(spark):
    grid = settings.product(spark, columns=settings.FEATURE_SIZES, lag=settings.PROJECTION_LAGS)
    assert grid.count() == 21 and grid.columns == ["columns", "lag"]
    assert len(settings.TIMESCALE_LAGS) == 21
