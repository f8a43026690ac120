"""Spectral quantities of Markov models: timescales, populations, passage times, scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tauframe.functions import dense
from tauframe.functions.hashing import digest_int, key_digest
from tauframe.operators.counting import count_transitions
from tauframe.operators.grouped import field_type, per_model
from tauframe.operators.sequences import hash_rank
from tauframe.session import materialise


def implied_timescales(counts: DataFrame, keys: Sequence[str] = ("lag",), n: int = 4) -> DataFrame:
    """``(keys.., k, eigenvalue, t)`` of the transpose-reversible model, k = 0..n-1 for the
    slowest processes. ``t`` is NULL where the eigenvalue has no timescale. ``keys`` must
    contain ``lag``."""
    if "lag" not in keys:
        raise ValueError("implied timescales need lag among the keys")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = dense.square(pdf, "n")
        lam, _, _ = dense.reversible_spectrum((c + c.T) / 2)
        t = dense.relaxation_times(lam, float(pdf["lag"].iloc[0]), n)
        padded = np.full(n, np.nan)
        padded[:max(0, min(n, len(lam) - 1))] = lam[1:n + 1]
        return pd.DataFrame({"k": np.arange(n), "eigenvalue": _nullable(padded),
                             "t": _nullable(t)})

    return per_model(counts, keys, solve, [("k", T.IntegerType()), ("eigenvalue", T.DoubleType()),
                                           ("t", T.DoubleType())])


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series([None if np.isnan(v) else float(v) for v in values], dtype=object)


def stationary(tpm: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """``(keys.., i, p)`` with ``pi T = pi`` for any irreducible matrix."""
    state = field_type(tpm, "i")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t, states = dense.square(pdf, "p")
        return pd.DataFrame({"i": states, "p": dense.stationary_vector(t)})

    return per_model(tpm, keys, solve, [("i", state), ("p", T.DoubleType())])


def mean_first_passage(tpm: DataFrame, lag_time: float, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., i, j, mfpt)`` in the unit of ``lag_time``. Negative entries are clipped and
    rows normalised by their own sum first."""
    state = field_type(tpm, "i")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t, states = dense.square(pdf, "p")
        t = dense.rows_to_one(np.clip(t, 0.0, None))
        return dense.long_form(dense.passage_times(t, lag_time)[None], states, "mfpt")

    return per_model(tpm, keys, solve, [("i", state), ("j", state), ("mfpt", T.DoubleType())])


# -- resampling of trajectories ------------------------------------------------------------

def number_trajectories(dtraj: DataFrame, seed: int = 0) -> DataFrame:
    """``(traj_id, idx)``: trajectories numbered 0..N-1 in hash order, as a written table, so that
    what reads the numbers and what counts them do not number again."""
    ids = materialise(dtraj.select("traj_id").distinct(), "ids")
    return materialise(hash_rank(ids, [], key_digest(seed, "traj_id"), ["traj_id"], "idx", ids.count()), "ids")


def _slots(numbered: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``(boot_id, idx)``: one row per draw."""
    total = numbered.count()
    slots = numbered.sparkSession.range(total).select(
        F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("boot_id"),
        F.col("id").alias("slot"))
    return slots.select("boot_id", F.pmod(digest_int(key_digest(seed, "boot_id", "slot")),
                                          F.lit(max(total, 1))).alias("idx"))


def bootstrap_draws(numbered: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """``(boot_id, traj_id, weight)``: each resample draws as many trajectories, with
    replacement, as there are; ``weight`` is how often one was drawn."""
    return (_slots(numbered, n_boot, seed).groupBy("boot_id", "idx").agg(F.count(F.lit(1)).alias("weight"))
            .join(numbered.hint("merge"), "idx").select("boot_id", "traj_id", "weight"))


def bootstrap_counts(dtraj: DataFrame, lags: Sequence[int], draws: DataFrame) -> DataFrame:
    """``(boot_id, lag, i, j, n)``. Counts add up over trajectories, so frames are counted
    once per lag and every resample is a weighted sum of per-trajectory counts."""
    # one row per trajectory on the draw side: the join copies nothing, and the resamples are
    # unfolded inside the task that adds them up
    picks = draws.groupBy("traj_id").agg(
        F.collect_list(F.struct("boot_id", "weight")).alias("_picks"))
    return _resampled(dtraj, lags, picks)


def _resampled(dtraj: DataFrame, lags: Sequence[int], picks: DataFrame) -> DataFrame:
    per_traj = count_transitions(dtraj, lags, keys=["traj_id"])
    # the planner takes a list for one value, so it would send all draws of all trajectories to every task
    return (per_traj.join(picks.hint("merge"), "traj_id")
            .select("lag", "i", "j", "n", F.explode("_picks").alias("_pick"))
            .groupBy(F.col("_pick.boot_id").alias("boot_id"), "lag", "i", "j")
            .agg(F.sum(F.col("n") * F.col("_pick.weight")).alias("n")))


def bootstrap_timescales(dtraj: DataFrame, lags: Sequence[int], n_boot: int, n: int = 4,
                         seed: int = 0) -> DataFrame:
    """``(boot_id, lag, k, eigenvalue, t)``. A trajectory's draws of all resamples meet in one
    shuffle by its number, without a table of weights between."""
    numbered = number_trajectories(dtraj, seed)
    picks = (_slots(numbered, n_boot, seed).groupBy("idx")
             .agg(F.collect_list(F.struct("boot_id", F.lit(1).alias("weight"))).alias("_picks"))
             .join(numbered.hint("merge"), "idx").select("traj_id", "_picks"))
    return implied_timescales(_resampled(dtraj, lags, picks), ["boot_id", "lag"], n)


def timescale_summary(its: DataFrame) -> DataFrame:
    """Mean and population standard deviation over resamples, by lag and process."""
    return its.groupBy("lag", "k").agg(F.avg("t").alias("mean_t"),
                                       F.stddev_pop("t").alias("std_t"),
                                       F.count("t").alias("n_finite"))


# -- cross-validated score -----------------------------------------------------------------

def assign_folds(trajectories: DataFrame, repeats: int, folds: int, seed: int = 0) -> DataFrame:
    """``(repeat, traj_id, fold)``: for each repeat an independent shuffle cut into ``folds``
    parts whose sizes differ by at most one."""
    ids = trajectories.select("traj_id").distinct()
    total = ids.count()
    cells = ids.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = hash_rank(cells, ["repeat"], key_digest(seed, "repeat", "traj_id"), ["traj_id"], "_r",
                       total)
    base, extra = divmod(total, folds)
    head = extra * (base + 1)        # rows of the ``extra`` folds that hold one more
    fold = F.when(F.col("_r") < head, F.floor(F.col("_r") / (base + 1))).otherwise(
        extra + F.floor((F.col("_r") - head) / max(base, 1)))
    return ranked.select("repeat", "traj_id", fold.cast("int").alias("fold"))


def fold_counts(dtraj: DataFrame, lag: int, assigned: DataFrame, folds: int,
                keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., repeat, fold, i, j, n_test, n_train)``; a trajectory's counts go to the test
    side of its own fold and to the train side of every other, so each frame is counted once.
    ``keys`` tell discretisations of the same trajectories apart."""
    keys = list(keys)
    per_traj = count_transitions(dtraj, [lag], keys=[*keys, "traj_id"], traj=[*keys, "traj_id"])
    own = (per_traj.join(assigned.withColumnRenamed("fold", "_own"), "traj_id")
           .groupBy(*keys, "repeat", "_own", "i", "j").agg(F.sum("n").alias("_n")))
    sides = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    tested = F.col("fold") == F.col("_own")
    return sides.groupBy(*keys, "repeat", "fold", "i", "j").agg(
        F.sum(F.when(tested, F.col("_n")).otherwise(0)).alias("n_test"),
        F.sum(F.when(tested, 0).otherwise(F.col("_n"))).alias("n_train"))


def rayleigh_scores(split_counts: DataFrame, n_timescales: int = 3,
                    keys: Sequence[str] = ("repeat", "fold")) -> DataFrame:
    """Generalised matrix Rayleigh quotient of each train/test split
    ``(keys.., train_score, test_score)`` (McGibbon & Pande, J. Chem. Phys. 142, 124105, 2015).
    NULL where a side has no score."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        states = dense.state_list(pdf)
        train, _ = dense.square(pdf, "n_train", states)
        test, _ = dense.square(pdf, "n_test", states)
        train, test = (train + train.T) / 2, (test + test.T) / 2
        known = train.sum(axis=1) > 0
        lam, vectors, _ = dense.reversible_spectrum(train[np.ix_(known, known)])
        top = min(n_timescales + 1, len(lam))
        basis = np.zeros((len(states), top))
        basis[known] = vectors[:, :top]
        flux = test / test.sum() if test.sum() else test
        weight = np.diag(flux.sum(axis=1))
        overlap = basis.T @ weight @ basis
        value = np.nan
        if np.linalg.matrix_rank(overlap) == top:
            value = float(np.trace(np.linalg.solve(overlap, basis.T @ flux @ basis)))
        return pd.DataFrame({"train_score": [float(lam[:top].sum())],
                             "test_score": _nullable(np.array([value]))})

    return per_model(split_counts, keys, score, [("train_score", T.DoubleType()),
                                                 ("test_score", T.DoubleType())])


def cross_validate(dtraj: DataFrame, lag: int, repeats: int = 10, folds: int = 6,
                   n_timescales: int = 3, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., repeat, fold, train_score, test_score)``. With ``keys`` naming a setting, all
    settings are scored in one job on the same splits."""
    assigned = assign_folds(dtraj, repeats, folds, seed)
    return rayleigh_scores(fold_counts(dtraj, lag, assigned, folds, keys), n_timescales,
                           [*keys, "repeat", "fold"])


def score_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test median and quartiles, train mean and population standard deviation."""
    return scores.groupBy(*keys).agg(
        F.percentile("test_score", F.lit(0.25)).alias("test_q1"),
        F.median("test_score").alias("test_median"),
        F.percentile("test_score", F.lit(0.75)).alias("test_q3"),
        F.min("test_score").alias("test_min"), F.max("test_score").alias("test_max"),
        F.avg("train_score").alias("train_mean"), F.stddev_pop("train_score").alias("train_std"),
        F.count(F.lit(1)).alias("n_scores"))
