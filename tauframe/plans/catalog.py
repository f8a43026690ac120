"""Every operator bound to the given tables. Keys match ``oracles.sql()``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tauframe.operators import (clustering, counting, covariance, features, lumping, memory,
                                reversible, sampling, sequences, series, spectrum, tica)
from tauframe.operators.many_centers import Run, k_centers_many
from tauframe.plans import bindings as bind
from tauframe.plans import pipeline, settings, sweep
from tauframe.session import materialise, scratch_path
from tauframe.sources import readers, sinks

PAIRS = [(i, j) for i in range(10) for j in range(i + 1, 10)]   # 10 atoms, 45 features
LAGS = [1, 2, 5]
SERIES_LEN = 12
DT = 1.0

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def r6(col: Column | str) -> Column:
    """Six decimals, no negative zero: sums of floats depend on the order of shuffled rows."""
    col = F.col(col) if isinstance(col, str) else col
    rounded = F.round(col, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def _series(spark, sf_dir) -> DataFrame:
    return series.matrix_series(bind.event_states(spark, sf_dir), SERIES_LEN)


def _saved_series(spark, sf_dir) -> DataFrame:
    """The series written once: it is small, and several steps read it."""
    return materialise(_series(spark, sf_dir), "series")


def _distances(spark, sf_dir) -> DataFrame:
    return features.pair_distances(bind.vector_coordinates(spark, sf_dir), PAIRS)


# -- sources and sinks ---------------------------------------------------------------------

@query
def index_list_read(spark, sf_dir):
    path = scratch_path(spark, "index")
    sizes = bind.table(spark, sf_dir, "part").select("p_size", "p_brand")
    lines = sizes.select(F.concat_ws(" ", F.col("p_size").cast("string"),
                                     F.col("p_size").cast("string")).alias("value"))
    lines.write.text(path)
    return readers.read_index_list(spark, path)


@query
def path_number_order(spark, sf_dir):
    pages = bind.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/data9/run"), F.col("page_id").cast("string"), F.lit(".xtc"))
    return pages.select("page_id", readers.file_number(path).alias("traj_id"))


@query
def features_parquet_roundtrip(spark, sf_dir):
    path = sinks.write_new(bind.vector_features(spark, sf_dir), scratch_path(spark, "features"))
    return (readers.read_rows(spark, path).select("vec_id", "traj_id", "frame", F.posexplode("x").alias("pos", "v"))
            .select("vec_id", "traj_id", "frame", "pos", r6("v").alias("v")))


@query
def load_one_frame(spark, sf_dir):
    frames = bind.vector_coordinates(spark, sf_dir)
    return (frames.where((F.col("traj_id") == 3) & (F.col("frame") == 2))
            .select("vec_id", "traj_id", "frame", F.posexplode("xyz").alias("pos", "v"))
            .select("vec_id", "traj_id", "frame", "pos", r6("v").alias("v")))


@query
def matrix_text_roundtrip(spark, sf_dir):
    path = sinks.write_matrix_text(series.flatten(_series(spark, sf_dir)),
                                   scratch_path(spark, "series"))
    flat = readers.ingest_series(readers.read_matrix_series(spark, path), SERIES_LEN, 5)
    return rounded(series.unflatten(flat), "p")


@query
def general_number_tsv(spark, sf_dir):
    rows = bind.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    path = sinks.write_tsv(rows, scratch_path(spark, "tsv"), general=True)
    return spark.read.schema("c_custkey bigint, c_acctbal string").csv(path, sep="\t", header=True)


@query
def frames_text_roundtrip(spark, sf_dir):
    """Two numbers a frame, as text in several files per trajectory, read back by line."""
    frames = bind.event_dihedrals(spark, sf_dir)
    path = sinks.write_frame_text(frames, ["psi", "phi"], scratch_path(spark, "frames"), parts=7)
    back = readers.read_frame_text(spark, path)
    return back.select("traj_id", "frame", F.col("m")[0].alias("psi"), F.col("m")[1].alias("phi"))


@query
def trajectory_files(spark, sf_dir):
    """The trajectories that a folder holds, by file listing."""
    frames = bind.order_states(spark, sf_dir).select("traj_id", "frame", F.col("frame").alias("x"))
    path = sinks.write_frame_text(frames.where("frame < 2"), ["x"], scratch_path(spark, "frames"), parts=3)
    return readers.list_trajectories(spark, path, "*.txt").select("traj_id").distinct()


@query
def structure_files(spark, sf_dir):
    """Sampled structures, one file each, read back."""
    frames = bind.vector_coordinates(spark, sf_dir)
    state = frames.select("traj_id", "frame", (F.col("vec_id") % 4).alias("state"))
    samples = sampling.sample_states(state, 10)
    name = F.concat(F.lit("macro"), F.col("state"), F.lit("_sample"), F.col("sample_no"), F.lit(".pdb"))
    named = sampling.sampled_structures(frames, samples).select(name.alias("output_filename"), "xyz")
    path = sinks.write_structures(named, _topology(frames), scratch_path(spark, "structures"))
    return readers.read_topology(spark, path, ["output_filename"]).drop("resname", "resid")


@query
def manifest_tsv(spark, sf_dir):
    made = sampling.manifest(sampling.sample_states(bind.event_states(spark, sf_dir), 10))
    path = sinks.write_tsv(made, scratch_path(spark, "manifest"))
    schema = "macro_state string, output_filename string, traj_index bigint, frame_index bigint"
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


@query
def resample_choices(spark, sf_dir):
    numbered = spectrum.number_trajectories(bind.event_states(spark, sf_dir))
    path = sinks.write_choices(spectrum.bootstrap_draws(numbered, 5), scratch_path(spark, "choice"))
    return (spark.read.schema("traj_id bigint, weight bigint, boot_id int").parquet(path)
            .select("boot_id", "traj_id", "weight"))


# -- sequences and counts ------------------------------------------------------------------

@query
def frame_index(spark, sf_dir):
    return bind.event_states(spark, sf_dir)


@query
def frame_index_orders(spark, sf_dir):
    return bind.order_states(spark, sf_dir)


@query
def frame_index_split(spark, sf_dir):
    """The path for long trajectories: the table is cut into cells of about 500 rows."""
    events = bind.table(spark, sf_dir, "events")
    return sequences.index_frames(events, "user_id", ["ts", "event_id"], ["event_id"], hot_rows=500)


@query
def frames_left_out(spark, sf_dir):
    """Rows of the orders, read through a nullable key, that have no place in a trajectory."""
    orders = bind.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("traj"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("day"))
    return sequences.missing_keys(orders, "traj", ["day"])


@query
def distinct_states(spark, sf_dir):
    return counting.distinct_states(bind.event_microstates(spark, sf_dir))


@query
def state_positions(spark, sf_dir):
    return sequences.state_positions(bind.event_states(spark, sf_dir), "purchase")


@query
def strided_frames(spark, sf_dir):
    return sequences.every_nth(bind.event_states(spark, sf_dir), 10)


@query
def stride_join(spark, sf_dir):
    angles = sequences.every_nth(bind.event_dihedrals(spark, sf_dir), 10)
    return sequences.align_frames(angles, sequences.every_nth(
        bind.event_states(spark, sf_dir), 10)).withColumnRenamed("state", "macrostate")


@query
def union_trajectories(spark, sf_dir):
    both = (bind.event_states(spark, sf_dir).withColumn("source", F.lit("events"))
            .unionByName(bind.order_states(spark, sf_dir).withColumn("source", F.lit("orders"))))
    return both.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"),
                                               F.max("frame").alias("last_frame"))


@query
def lagged_pairs(spark, sf_dir):
    return (counting.lagged_pairs(bind.event_states(spark, sf_dir), [3])
            .select("traj_id", "frame", "lag", "i", "j"))


@query
def transition_counts(spark, sf_dir):
    return counting.count_transitions(bind.event_states(spark, sf_dir), LAGS)


@query
def transition_counts_orders(spark, sf_dir):
    return counting.count_transitions(bind.order_states(spark, sf_dir), LAGS)


@query
def transition_counts_micro(spark, sf_dir):
    return counting.count_transitions(bind.event_microstates(spark, sf_dir), [1, 10])


@query
def counts_per_trajectory(spark, sf_dir):
    return counting.count_transitions(bind.event_states(spark, sf_dir), [1], keys=["traj_id"])


@query
def lag_sweep_counts(spark, sf_dir):
    """40 lags in one Arrow pass."""
    return counting.count_transitions(bind.event_states(spark, sf_dir), range(1, 41),
                                      method="arrow")


@query
def lag_equality_filter(spark, sf_dir):
    counts = counting.count_transitions(bind.event_states(spark, sf_dir), [1, 10])
    return counts.where(F.col("lag") == 10)


@query
def tpm_lag(spark, sf_dir):
    tpm = counting.transition_matrix(counting.count_transitions(
        bind.event_states(spark, sf_dir), [2]))
    return tpm.select("i", "j", "n", r6("p").alias("p"))


@query
def tpm_transpose(spark, sf_dir):
    counts = counting.count_transitions(bind.event_states(spark, sf_dir), LAGS)
    return rounded(counting.transition_matrix(counts, reversible="transpose"), "p")


@query
def tpm_reversible_mle(spark, sf_dir):
    counts = counting.count_transitions(bind.order_states(spark, sf_dir), [1, 2])
    return rounded(counting.transition_matrix(counts, reversible="mle"), "p", "pi")


@query
def tpm_slow_mle(spark, sf_dir):
    """States that change every tenth frame and only to a neighbour. Counts without cycles: the
    reversible maximum is the plain row-normalised matrix."""
    step = F.floor(F.col("frame") / 10) % 4
    slow = bind.event_states(spark, sf_dir).select(
        "traj_id", "frame", F.when(step == 3, F.lit(1)).otherwise(step).cast("int").alias("state"))
    made = counting.transition_matrix(counting.count_transitions(slow, [1]), reversible="mle")
    return rounded(made.select("i", "j", "p"), "p")


@query
def populations_transpose(spark, sf_dir):
    counts = counting.count_transitions(bind.event_states(spark, sf_dir), LAGS)
    return rounded(counting.populations(counting.symmetrise(counts)), "p")


@query
def populations_stationary(spark, sf_dir):
    counts = counting.count_transitions(bind.event_states(spark, sf_dir), LAGS)
    return rounded(spectrum.stationary(counting.transition_matrix(counts)), "p")


def _strong_counts(spark, sf_dir):
    """Microstate counts, and the count that nine tenths of the transitions do not exceed."""
    counts = materialise(counting.count_transitions(bind.event_microstates(spark, sf_dir), [1]),
                         "counts")
    return counts, float(counts.agg(F.percentile("n", F.lit(0.9))).first()[0])


@query
def ergodic_trimming(spark, sf_dir):
    counts, cutoff = _strong_counts(spark, sf_dir)
    return reversible.ergodic_states(counts, cutoff=cutoff)


@query
def trimmed_counts(spark, sf_dir):
    counts, cutoff = _strong_counts(spark, sf_dir)
    return reversible.trim_counts(counts, reversible.ergodic_states(counts, cutoff=cutoff))


# -- series --------------------------------------------------------------------------------

@query
def tpm_series(spark, sf_dir):
    return rounded(_series(spark, sf_dir), "p")


@query
def tpm_series_mle(spark, sf_dir):
    return rounded(series.matrix_series(bind.order_states(spark, sf_dir), 3, reversible="mle"), "p")


@query
def tpm_derivative(spark, sf_dir):
    return rounded(series.derivative(_series(spark, sf_dir), 0.1), "dp")


@query
def tpm_normalisation_check(spark, sf_dir):
    return series.normalisation(_series(spark, sf_dir))


@query
def tpm_column_oriented(spark, sf_dir):
    """A column-normalised series comes out row-normalised."""
    return rounded(series.orient(reversible.transpose(_series(spark, sf_dir))), "p")


@query
def tpm_flattened(spark, sf_dir):
    flat = series.with_time(series.flatten(_series(spark, sf_dir)), 0.1)
    return (flat.select("k", F.posexplode("row").alias("pos", "v"))
            .select("k", "pos", r6("v").alias("v")))


@query
def tpm_last(spark, sf_dir):
    return rounded(series.last_matrix(_series(spark, sf_dir)), "p")


@query
def negatives_clipped(spark, sf_dir):
    slope = series.derivative(_series(spark, sf_dir), DT).withColumnRenamed("dp", "p")
    return rounded(reversible.clip_negative(slope), "p")


@query
def state_dropped(spark, sf_dir):
    return rounded(reversible.drop_state(_series(spark, sf_dir), "error"), "p")


# -- memory models -------------------------------------------------------------------------

KERNEL_STEPS = 8


def _kernel(made: DataFrame) -> DataFrame:
    return memory.memory_kernel(made, DT, KERNEL_STEPS)


@query
def initial_rate(spark, sf_dir):
    return rounded(memory.initial_rate(_series(spark, sf_dir), DT), "rate")


@query
def memory_kernel(spark, sf_dir):
    made = memory.memory_kernel(_series(spark, sf_dir), DT, 5)
    return rounded(memory.kernel_table(made, DT), "kernel")


@query
def mean_integral_kernel(spark, sf_dir):
    return rounded(memory.mean_integral_kernel(_kernel(_series(spark, sf_dir)), DT, 6), "mik")


@query
def memory_prediction(spark, sf_dir):
    made = _saved_series(spark, sf_dir)
    return rounded(memory.predict_memory(made, _kernel(made), DT, tau=4, end=8), "p")


@query
def markov_prediction(spark, sf_dir):
    return rounded(memory.predict_markov(_series(spark, sf_dir), 0.1, tau=3, end=12), "p")


@query
def markov_prediction_compat(spark, sf_dir):
    return rounded(memory.predict_markov(_series(spark, sf_dir), 0.1, tau=3, end=12, compat=True,
                                         add_identity=True), "p")


@query
def comparison_table(spark, sf_dir):
    made = _saved_series(spark, sf_dir)
    table = memory.comparison_table(
        made, memory.predict_memory(made, _kernel(made), DT, tau=4, end=8),
        memory.predict_markov(made, DT, tau=4, end=8), tau=4, every=1, diagonal=False)
    return rounded(table, "observed", "memory", "markov")


@query
def comparison_thinned(spark, sf_dir):
    """Observed points thinned below the Markov step, both predictions in full, and lag 0."""
    made = _saved_series(spark, sf_dir)
    table = memory.comparison_table(
        made, memory.predict_memory(made, _kernel(made), DT, tau=4, end=8),
        memory.predict_markov(made, DT, tau=4, end=8), tau=4, every=2, diagonal=False, identity=True)
    return rounded(table, "observed", "memory", "markov")


@query
def rmse_sweep(spark, sf_dir):
    made = _saved_series(spark, sf_dir)
    return rounded(memory.rmse_sweep(made, _kernel(made), DT, end=7), "memory_rmse", "markov_rmse")


@query
def rmse_sweep_compat(spark, sf_dir):
    made = _saved_series(spark, sf_dir)
    return rounded(memory.rmse_sweep(made, _kernel(made), DT, end=7, compat=True),
                   "memory_rmse", "markov_rmse")


@query
def rmse_from_flat(spark, sf_dir):
    """The same errors through the model object, from a flattened series."""
    model = memory.MemoryModel.from_flat(series.flatten(_series(spark, sf_dir)), SERIES_LEN, 5, DT)
    return rounded(model.with_kernel(KERNEL_STEPS).rmse(end=7), "memory_rmse", "markov_rmse")


@query
def mean_first_passage(spark, sf_dir):
    return rounded(spectrum.mean_first_passage(_series(spark, sf_dir), 200.0, ["k"]), "mfpt")


@query
def mean_first_passage_predicted(spark, sf_dir):
    """Passage times from the last predicted matrix, the end of the usual chain."""
    made = _saved_series(spark, sf_dir)
    last = series.last_matrix(memory.predict_memory(made, _kernel(made), DT, tau=4, end=8)
                              .withColumnRenamed("idx", "k"))
    return rounded(spectrum.mean_first_passage(last, 8.0), "mfpt")


# -- timescales, resampling, scores --------------------------------------------------------

@query
def implied_timescales(spark, sf_dir):
    counts = counting.count_transitions(bind.event_states(spark, sf_dir), LAGS)
    return rounded(spectrum.implied_timescales(counts, ["lag"], 4), "eigenvalue", "t")


@query
def bootstrap_draws(spark, sf_dir):
    numbered = spectrum.number_trajectories(bind.event_states(spark, sf_dir))
    return spectrum.bootstrap_draws(numbered, 5)


@query
def resampled_frames(spark, sf_dir):
    """Frames of each state in each resample: a join that repeats drawn trajectories."""
    dtraj = bind.event_states(spark, sf_dir)
    draws = spectrum.bootstrap_draws(spectrum.number_trajectories(dtraj), 5)
    return (dtraj.groupBy("traj_id", "state").agg(F.count(F.lit(1)).alias("_n"))
            .join(draws, "traj_id").groupBy("boot_id", "state")
            .agg(F.sum(F.col("_n") * F.col("weight")).alias("n")))


@query
def bootstrap_timescales(spark, sf_dir):
    dtraj = bind.order_states(spark, sf_dir)
    return rounded(spectrum.bootstrap_timescales(dtraj, [1, 2, 3], 20, 2), "eigenvalue", "t")


@query
def bootstrap_summary(spark, sf_dir):
    dtraj = bind.order_states(spark, sf_dir)
    its = spectrum.bootstrap_timescales(dtraj, [1, 2, 3], 20, 2)
    return rounded(spectrum.timescale_summary(its), "mean_t", "std_t")


@query
def fold_assignment(spark, sf_dir):
    return spectrum.assign_folds(bind.order_states(spark, sf_dir), 3, 6)


@query
def fold_counts(spark, sf_dir):
    dtraj = bind.order_states(spark, sf_dir)
    return spectrum.fold_counts(dtraj, 1, spectrum.assign_folds(dtraj, 3, 6), 6)


@query
def rayleigh_scores(spark, sf_dir):
    dtraj = bind.order_states(spark, sf_dir)
    return rounded(spectrum.cross_validate(dtraj, 1, 3, 6, n_timescales=1),
                   "train_score", "test_score")


@query
def rayleigh_summary(spark, sf_dir):
    scores = spectrum.cross_validate(bind.order_states(spark, sf_dir), 1, 3, 6, n_timescales=1)
    return rounded(spectrum.score_summary(scores), "test_q1", "test_median", "test_q3", "test_min",
                   "test_max", "train_mean", "train_std")


@query
def rayleigh_sweep(spark, sf_dir):
    """Two discretisations of the same trajectories, scored on the same splits, summarised."""
    orders = bind.table(spark, sf_dir, "orders")
    runs = {"status": F.col("o_orderstatus"),
            "key": F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string"))}
    frames = sequences.index_frames(orders, "o_custkey", ["o_orderdate", "o_orderkey"],
                                    ["o_orderstatus", "o_orderkey"])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("run_id"), state.alias("state"))
                               for name, state in runs.items()]))
    both = (frames.select("traj_id", "frame", each.alias("_r"))
            .select("_r.run_id", "traj_id", "frame", "_r.state"))
    scores = spectrum.cross_validate(both, 1, 3, 6, n_timescales=1, keys=["run_id"])
    return rounded(spectrum.score_summary(scores, ["run_id"]).select(
        "run_id", "test_median", "train_mean", "train_std", "n_scores"),
        "test_median", "train_mean", "train_std")


@query
def rayleigh_scores_micro(spark, sf_dir):
    """Three timescales on 20 states, 10 repeats of 6 folds."""
    return rounded(spectrum.cross_validate(bind.event_microstates(spark, sf_dir), 1, 10, 6, 3),
                   "train_score", "test_score")


@query
def sampled_states(spark, sf_dir):
    return sampling.sample_states(bind.event_states(spark, sf_dir), 10)


@query
def sampled_states_distinct(spark, sf_dir):
    return sampling.sample_states(bind.event_states(spark, sf_dir), 10, replace=False)


@query
def sampled_structures(spark, sf_dir):
    frames = bind.vector_coordinates(spark, sf_dir)
    state = frames.select("traj_id", "frame", (F.col("vec_id") % 4).alias("state"))
    got = sampling.sampled_structures(frames, sampling.sample_states(state, 5))
    # every coordinate, as one text per structure
    return got.select("state", "sample_no", "traj_id", "frame", "vec_id", F.array_join(F.transform(
        "xyz", lambda v: F.round(v * 1000).cast("int").cast("string")), " ").alias("xyz"))


def _topology(frames: DataFrame) -> DataFrame:
    """Names for the points of the vectors."""
    serial = F.explode(F.sequence(F.lit(1), (F.size("xyz") / 3).cast("int")))
    return frames.select(serial.alias("serial")).distinct().select(
        "serial", F.concat(F.lit("A"), F.col("serial").cast("string")).alias("name"),
        F.lit("MOL").alias("resname"), F.lit(1).alias("resid"))


@query
def structure_lines(spark, sf_dir):
    """Every vector as the atom records of a structure file."""
    frames = bind.vector_coordinates(spark, sf_dir)
    named = frames.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("output_filename"),
                          "xyz")
    return sinks.pdb_lines(named, _topology(frames))


# -- features ------------------------------------------------------------------------------

@query
def atom_pairs(spark, sf_dir):
    atoms = bind.table(spark, sf_dir, "part").select((F.col("p_size") - 1).alias("atom"))
    return features.pair_table(atoms)


@query
def pair_distances(spark, sf_dir):
    long = _distances(spark, sf_dir).select("traj_id", "frame",
                                            F.posexplode("x").alias("feature_id", "d"))
    return rounded(long, "d")


@query
def pair_distances_long(spark, sf_dir):
    """From one row per atom."""
    atoms = features.unpack_coordinates(bind.vector_coordinates(spark, sf_dir))
    return rounded(features.distances_long(atoms, PAIRS), "d")


@query
def selected_columns(spark, sf_dir):
    x = features.select_columns(bind.vector_features(spark, sf_dir), [5, 0, 17])
    return x.select("vec_id", *[r6(F.col("x")[k]).alias(f"x{k}") for k in range(3)])


@query
def leading_columns(spark, sf_dir):
    x = features.leading_columns(bind.vector_features(spark, sf_dir), 3, "x")
    return (x.select("vec_id", F.posexplode("x").alias("pos", "v"))
            .select("vec_id", "pos", r6("v").alias("v")))


@query
def lagged_moments(spark, sf_dir):
    made = covariance.lagged_moments(bind.vector_features(spark, sf_dir), [1, 2])
    return rounded(covariance.raw_sums(made), "sx", "sy", "same", "cross")


@query
def lagged_comoments(spark, sf_dir):
    """Means, and sums of products of deviations, as they are added up."""
    made = covariance.lagged_moments(bind.vector_features(spark, sf_dir), [1, 5])
    return rounded(made, "mx_i", "my_i", "mx_j", "my_j", "same", "cross")


@query
def covariance_matrices(spark, sf_dir):
    made = covariance.lagged_moments(bind.vector_features(spark, sf_dir), [2])
    return rounded(covariance.covariance_table(made), "c0", "ct")


@query
def tica_timescales(spark, sf_dir):
    made = covariance.lagged_moments(bind.vector_features(spark, sf_dir), [1, 2])
    return rounded(tica.tica_timescales(made, 4), "eigenvalue", "t")


@query
def tica_projection(spark, sf_dir):
    x = _distances(spark, sf_dir)
    y = tica.fit_tica(x, 2, n_components=10).transform(x)
    return (y.select("traj_id", "frame", F.posexplode("y").alias("k", "y"))
            .select("traj_id", "frame", "k", r6("y").alias("y")))


@query
def feature_selection(spark, sf_dir):
    moments = covariance.lagged_moments(_distances(spark, sf_dir), [2, 4, 6])
    return rounded(tica.select_features(moments, [4, 8, 12, 16, 20, 24, 28]), "t")


@query
def feature_selection_small(spark, sf_dir):
    """The first four of the 45 distances, from a seeded start."""
    moments = covariance.lagged_moments(_distances(spark, sf_dir), [2, 4, 6])
    return rounded(tica.select_features(moments, [1, 2, 3, 4]), "t")


@query
def feature_start(spark, sf_dir):
    """The seeded start column of each lag: one of the features, without replacement."""
    lags = counting.count_transitions(bind.event_states(spark, sf_dir), range(1, 7)).select("lag").distinct()
    return lags.select("lag", *[tica.start_column_of(F.lit(seed), F.col("lag"), 45).alias(f"seed{seed}") for seed in (0, 1)])


@query
def feature_selection_pairs(spark, sf_dir):
    """The first two of all 64 columns, starting from column 0."""
    moments = covariance.lagged_moments(bind.vector_features(spark, sf_dir), [1, 2])
    return rounded(tica.select_features(moments, [1, 2], first=0), "t")


@query
def tica_projection_few(spark, sf_dir):
    x = bind.vector_features(spark, sf_dir)
    y = tica.fit_tica(x, 1, n_components=2).transform(x)
    return y.select("vec_id", "traj_id", "frame", r6(F.col("y")[0]).alias("y0"),
                    r6(F.col("y")[1]).alias("y1"))


@query
def timescale_curve(spark, sf_dir):
    moments = materialise(covariance.lagged_moments(bind.vector_features(spark, sf_dir), [1, 2]), "moments")
    return rounded(tica.timescale_curve(tica.select_features(moments, [1, 2], first=0),
                                        tica.tica_timescales(moments, 1), 64, 0.1), "t")


# -- clustering and lumping ----------------------------------------------------------------

def _points(spark, sf_dir) -> DataFrame:
    return bind.vector_features(spark, sf_dir).withColumnRenamed("x", "y")


@query
def k_centers(spark, sf_dir):
    got = clustering.k_centers(_points(spark, sf_dir), 6, first=(0, 0))
    return rounded(got.assigned, "distance")


@query
def k_centers_found(spark, sf_dir):
    got = clustering.k_centers(_points(spark, sf_dir), 6, first=(0, 0))
    return got.center_table(spark).select("state", "traj_id", "frame")


@query
def nearest_center(spark, sf_dir):
    """Assignment to given centers: the first frame of each of four trajectories."""
    points = _points(spark, sf_dir)
    firsts = (points.where((F.col("frame") == 0) & (F.col("traj_id") < 4))
              .orderBy("traj_id").limit(4).collect())
    return rounded(clustering.assign_nearest(points, np.array([r["y"] for r in firsts])),
                   "distance")


@query
def clustering_sweep(spark, sf_dir):
    """State sizes for each setting: equal settings are clustered once, all in the same passes."""
    grid = settings.one_at_a_time(spark, {"no_components": 3, "no_clusters": 6},
                                  {"no_components": [2, 3, 5], "no_clusters": [6, 9, 12]})
    runs = {r.run_id: Run("y", r.no_components, r.no_clusters) for r in grid.collect()}
    found = k_centers_many(_points(spark, sf_dir), runs)
    sizes = found.assigned.groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(sizes, "run_id").select("parameter", "value", "state", "n")


@query
def clustering_settings(spark, sf_dir):
    """Four named parameters, each varied with the others at their base: features selected, projected
    and clustered for every setting, and the settings' cross-validated scores."""
    grid = settings.one_at_a_time(
        spark, {"no_features": 24, "no_components": 3, "no_clusters": 8, "tica_lagtime": 2},
        {"no_features": [20, 24, 28], "no_components": [2, 3, 4], "no_clusters": [7, 8, 9], "tica_lagtime": [2, 4, 6]})
    made = sweep.score_settings(_distances(spark, sf_dir), grid, lag=1, repeats=3, folds=5, n_timescales=2)
    return rounded(made.summary, "test_q1", "test_median", "test_q3", "test_min", "test_max", "train_mean", "train_std")


@query
def settings_table(spark, sf_dir):
    """The published settings by name with the run each one shares, and how many frames each reads."""
    grid = settings.one_at_a_time(spark)
    frames = bind.vector_features(spark, sf_dir).agg(F.count(F.lit(1)).alias("frames")).scalar()
    return grid.withColumn("frames", frames)


@query
def macrostates(spark, sf_dir):
    counts = counting.count_transitions(bind.event_microstates(spark, sf_dir), [1])
    return rounded(lumping.lump_states(counts, 4), "membership")


@query
def macrostates_two(spark, sf_dir):
    counts = counting.count_transitions(bind.event_microstates(spark, sf_dir), [1])
    return rounded(lumping.lump_states(counts, 2), "membership")


@query
def macrostate_series_two(spark, sf_dir):
    """The chain of ``macrostate_series`` with two macrostates."""
    micro = materialise(bind.event_microstates(spark, sf_dir), "microstates")
    lumped = lumping.lump_states(counting.count_transitions(micro, [1]), 2)
    return rounded(series.matrix_series(lumping.apply_lumping(micro, lumped), 10, reversible="mle"), "p")


@query
def macrostate_series(spark, sf_dir):
    """Microstates -> lumping -> reversible matrices of the macrostates over a lag sweep."""
    micro = materialise(bind.event_microstates(spark, sf_dir), "microstates")
    lumped = lumping.lump_states(counting.count_transitions(micro, [1]), 4)
    macro = lumping.apply_lumping(micro, lumped)
    return rounded(series.matrix_series(macro, 10, reversible="mle"), "p")


def _one_way_states(spark, sf_dir):
    """Three macrostates by a fixed rule, and states that have no way back: 8 is only left (first
    frames), 9 only entered (last frames), 7 (third frames of some trajectories) has both ways at lag
    1 alone."""
    micro = bind.event_microstates(spark, sf_dir)
    last = F.lead("frame").over(Window.partitionBy("traj_id").orderBy("frame")).isNull()
    rule = F.when(F.col("state").endswith("0"), 0).when(F.col("state").endswith("3"), 2).otherwise(1)
    return micro.select("traj_id", "frame", F.when(F.col("frame") == 0, 8).when(last, 9).when(
        (F.col("frame") == 2) & (F.col("traj_id") % 3 == 0), 7).otherwise(rule).alias("state"))


@query
def kinetic_chain(spark, sf_dir):
    """From coordinates to a memory kernel: distances, projection, clustering, trimming, lumping, the
    macrostates' reversible series and its kernel."""
    dtraj = pipeline.discretise(_distances(spark, sf_dir), lag=2, n_components=3, n_clusters=8)
    model = pipeline.macro_model(dtraj, micro_lag=1, n_macro=2, n_lags=6, dt=DT, kernel_steps=4)
    kernel = model.kernel.select(F.lit("kernel").alias("part"), F.col("n").alias("k"), "i", "j", F.col("kernel").alias("p"))
    both = model.series.select(F.lit("series").alias("part"), "k", "i", "j", "p").unionByName(kernel)
    return both.select("part", "k", "i", "j", r6("p").alias("value"))


@query
def macrostate_series_trimmed(spark, sf_dir):
    """Reversible matrices over a lag sweep, on the states connected both ways at every lag."""
    return rounded(series.matrix_series(_one_way_states(spark, sf_dir), 4, reversible="mle", trim=True), "p")


@query
def macrostates_trimmed(spark, sf_dir):
    """What trimming leaves out, by lag and state."""
    counts = materialise(counting.count_transitions(_one_way_states(spark, sf_dir), range(1, 5)), "counts")
    return reversible.trimmed_states(counts, reversible.common_states(counts))


@query
def macrostate_map(spark, sf_dir):
    """The join half of lumping, with a fixed rule as the map."""
    micro = bind.event_microstates(spark, sf_dir)
    rule = counting.distinct_states(micro).withColumn(
        "macrostate", F.when(F.col("state").endswith("0"), 0).when(
            F.col("state").endswith("3"), 2).otherwise(1))
    return counting.count_transitions(lumping.apply_lumping(micro, rule), LAGS)
