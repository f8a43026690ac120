"""Non-Markovian propagation: memory kernels, their integral, predictions and their errors.

The model is the discretised generalised master equation of J. Chem. Phys. 153,
014105 (2020). A series holds L matrices of a handful of states, so one model is one small
group; independent models, and independent memory times of a sweep, run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tauframe.functions import dense
from tauframe.operators.grouped import field_type, per_model
from tauframe.operators.sequences import estimated_bytes, every_nth
from tauframe.operators.series import derivative, orient, unflatten
from tauframe.session import materialise
from tauframe.sources.readers import ingest_series


def initial_rate(series: DataFrame, dt: float, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., i, j, rate)``: T0^-1 (T1 - T0) / dt, the memoryless rate at time zero."""
    state = field_type(series, "i")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s, states = dense.tensor(pdf, "p")
        return dense.long_form(np.linalg.solve(s[0], (s[1] - s[0]) / dt)[None], states, "rate")

    return per_model(series.where(F.col("k") < 2), keys, solve,
                     [("i", state), ("j", state), ("rate", T.DoubleType())])


def memory_kernel(series: DataFrame, dt: float, steps: int = 10,
                  keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., n, i, j, kernel)`` for n = 0..steps-1. Needs ``steps + 1`` matrices."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    state = field_type(series, "i")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s, states = dense.tensor(pdf, "p")
        out = dense.long_form(dense.memory_kernel(s, dt, steps), states, "kernel")
        return out.rename(columns={"k": "n"})

    return per_model(series.where(F.col("k") <= steps), keys, solve,
                     [("n", T.IntegerType()), ("i", state), ("j", state),
                      ("kernel", T.DoubleType())])


def kernel_table(kernel: DataFrame, dt: float, keys: Sequence[str] = ()) -> DataFrame:
    """Kernel elements against time ``(n + 1) dt``: the data behind a kernel plot."""
    return kernel.select(*keys, "n", ((F.col("n") + 1) * F.lit(float(dt))).alias("time"),
                         "i", "j", "kernel")


def mean_integral_kernel(kernel: DataFrame, dt: float, steps: int,
                         keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., n, time, mik)``: norm of the running time integral of the kernel, per state."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    keys = list(keys)
    running = Window.partitionBy(*keys, "i", "j").orderBy("n").rowsBetween(
        Window.unboundedPreceding, 0)
    integral = kernel.where(F.col("n") < steps).withColumn(
        "_int", F.sum("kernel").over(running) * F.lit(float(dt)))
    out = integral.groupBy(*keys, "n").agg(
        (F.sqrt(F.sum(F.col("_int") * F.col("_int"))) / F.sqrt(F.count(F.lit(1)))).alias("mik"))
    # "kernel shorter than asked for" shows as a missing last step
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    enough = F.when(F.max("n").over(whole) == steps - 1, F.col("mik")).otherwise(
        F.raise_error("kernel is shorter than the integration time").cast("double"))
    return out.select(*keys, "n", ((F.col("n") + 1) * F.lit(float(dt))).alias("time"),
                      enough.alias("mik"))


def _check_window(tau: int, end: int) -> None:
    if tau < 2:
        raise ValueError("memory time must span at least 2 steps")
    if tau >= end:
        raise ValueError("memory time must be shorter than the end point")


def predict_memory(series: DataFrame, kernel: DataFrame, dt: float, tau: int = 10, end: int = 100,
                   keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., idx, lag, time, i, j, p)`` for idx = 0..end.

    ``lag = (idx + 1) dt`` is the lag time of the matrix; ``time = idx dt`` is the plotting
    label users of the published tool know. The kernel needs more than ``tau + 1`` steps.
    """
    _check_window(tau, end)
    state = field_type(series, "i")
    both = _stack(series, kernel, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, kern, states = _unstack(pdf)
        if len(kern) <= tau + 1:
            raise ValueError("kernel is too short for this memory time")
        out = dense.long_form(dense.propagate_memory(s, kern, dt, tau, end), states, "p")
        return _timed(out.rename(columns={"k": "idx"}), dt)

    return per_model(both, keys, run, _timed_schema(state))


def _timed(out: pd.DataFrame, dt: float) -> pd.DataFrame:
    out["lag"] = (out["idx"] + 1) * dt
    out["time"] = out["idx"] * dt
    return out


def _timed_schema(state: T.DataType) -> list:
    return [("idx", T.IntegerType()), ("lag", T.DoubleType()), ("time", T.DoubleType()),
            ("i", state), ("j", state), ("p", T.DoubleType())]


def _stack(series: DataFrame, kernel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series and kernel of one model in one group."""
    a = series.select(*keys, F.lit("p").alias("part"), "k", "i", "j", "p")
    b = kernel.select(*keys, F.lit("kernel").alias("part"), F.col("n").alias("k"), "i", "j",
                      F.col("kernel").alias("p"))
    return a.unionByName(b)


def _unstack(pdf: pd.DataFrame):
    states = dense.state_list(pdf)
    s, _ = dense.tensor(pdf[pdf["part"] == "p"], "p", states)
    kern, _ = dense.tensor(pdf[pdf["part"] == "kernel"], "p", states)
    return s, kern, states


def predict_markov(series: DataFrame, dt: float, tau: int = 10, end: int = 100,
                   add_identity: bool = False, compat: bool = False,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Powers of one matrix: ``(keys.., r, lag, time, i, j, p)``, r = 1 .. end // tau.

    The base is the matrix at lag ``tau dt`` (step tau - 1). ``compat=True`` takes step ``tau``,
    one step later than its label says, as the published tool does. ``r = 0`` is the identity.
    """
    if tau < 1 or tau >= end:
        raise ValueError("tau must be at least 1 and shorter than the end point")
    state = field_type(series, "i")
    base = tau if compat else tau - 1
    count = end // tau

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, states = dense.square(pdf, "p")
        stack, first = dense.matrix_powers(t, count), 1
        if add_identity:
            stack, first = np.concatenate([np.eye(len(t))[None], stack]), 0
        out = dense.long_form(stack, states, "p", first).rename(columns={"k": "r"})
        out["time"] = out["r"] * (tau * dt)
        out["lag"] = out["r"] * ((base + 1) * dt)
        return out

    return per_model(series.where(F.col("k") == base), keys, run,
                     [("r", T.IntegerType()), ("lag", T.DoubleType()), ("time", T.DoubleType()),
                      ("i", state), ("j", state), ("p", T.DoubleType())])


def comparison_table(series: DataFrame, predicted: DataFrame, markov: DataFrame | None, tau: int,
                     every: int = 10, diagonal: bool = True, keys: Sequence[str] = (),
                     complete: bool = True, identity: bool = False) -> DataFrame:
    """Chapman-Kolmogorov test as rows ``(keys.., k, i, j, observed, memory, markov)``.

    Everything is aligned on the integer step of the lag: the memory prediction at each of its
    steps, the Markov powers at the steps whose lag they are, and the observed series, thinned to
    every ``every``-th step, NULL between. ``identity`` adds the matrix at lag 0 as step -1.
    ``complete=False`` keeps only steps that the thinned series and the prediction share.
    """
    on = [*keys, "k", "i", "j"]
    observed = every_nth(series.withColumnRenamed("k", "frame"), every).select(
        *keys, F.col("frame").alias("k"), "i", "j", F.col("p").alias("observed"))
    out = predicted.select(*keys, F.col("idx").alias("k"), "i", "j", F.col("p").alias("memory"))
    if not complete:
        out = out.join(observed, on)
    if markov is None:
        out = out.withColumn("markov", F.lit(None).cast("double"))
    else:
        step = (F.col("r") * tau - 1).alias("k")
        out = out.join(markov.where(F.col("r") > 0).select(
            *keys, step, "i", "j", F.col("p").alias("markov")), on, "full" if complete else "left")
    if complete:
        out = out.join(observed, on, "left")
    if identity:
        one = (F.col("i") == F.col("j")).cast("double")
        cells = out.where(F.col("k") == 0).withColumn("k", F.lit(-1))
        out = out.unionByName(cells.withColumns({c: one for c in ("observed", "memory", "markov")}))
    if diagonal:
        out = out.where(F.col("i") == F.col("j"))
    return out.select(*on, "observed", "memory", "markov")


def rmse_sweep(series: DataFrame, kernel: DataFrame, dt: float, end: int = 100, pi_step: int = 10,
               keys: Sequence[str] = (), compat: bool = False, taus: Sequence[int] | None = None
               ) -> DataFrame:
    """``(keys.., tau, time, memory_rmse, markov_rmse)`` in percent for tau = 2 .. end-1.

    Differences to the observed series are weighted by the stationary populations of step
    ``pi_step``. Each tau is its own task. ``compat=True`` keeps three habits of the published
    tool: base matrix one step late, comparison index from a truncated float time, and the
    memory error averaged over one matrix too many.
    """
    taus = list(range(2, end)) if taus is None else list(taus)
    for tau in taus:
        _check_window(tau, end)
    keys = list(keys)
    packed = _packed(series, kernel, keys)
    rows = _with_taus(packed, taus)
    kept = [packed.schema[k] for k in keys]

    def errors(tau: int, s: np.ndarray, kern: np.ndarray) -> tuple[float, float, float]:
        if len(kern) - 1 < end:
            raise ValueError("kernel is shorter than the end point")
        if len(s) < end or len(s) <= pi_step:
            raise ValueError("series is shorter than the end point or the population step")
        pi = dense.stationary_vector(s[pi_step])[:, None]
        memory = dense.propagate_memory(s, kern, dt, tau, end)[:end]
        powers = dense.matrix_powers(s[tau if compat else tau - 1], end // tau)
        if compat:
            label = np.cumsum(np.full(len(powers), tau * dt))
            at = (label / dt - 1).astype(int)
        else:
            at = tau * np.arange(1, len(powers) + 1) - 1
        n = end + 1 if compat else end
        return tau * dt, _percent(pi * (memory - s[:end]), n), _percent(pi * (powers - s[at]), len(powers))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            made = [errors(int(tau), np.reshape(s, (-1, d, d)), np.reshape(kern, (-1, d, d)))
                    for tau, d, s, kern in zip(pdf["tau"], pdf["_d"], pdf["_s"], pdf["_kern"])]
            yield pdf[[*keys, "tau"]].assign(**dict(zip(("time", "memory_rmse", "markov_rmse"), zip(*made))))

    return rows.mapInPandas(run, T.StructType([
        *kept, T.StructField("tau", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("time", "memory_rmse", "markov_rmse")]]))


def _packed(series: DataFrame, kernel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One written row per model: series and kernel as row-major numbers over the sorted states."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        s, kern, states = _unstack(pdf)
        return pd.DataFrame({"_one": [0], "_d": [len(states)], "_s": [s.reshape(-1)], "_kern": [kern.reshape(-1)]})

    numbers = T.ArrayType(T.DoubleType())
    return materialise(per_model(_stack(series, kernel, keys), keys, pack, [
        ("_one", T.IntegerType()), ("_d", T.IntegerType()), ("_s", numbers), ("_kern", numbers)]), "model")


def _with_taus(packed: DataFrame, taus: Sequence[int]) -> DataFrame:
    """Every model with every tau. The written models' size is known: small ones are broadcast to the
    rows of tau by the planner's own choice, large ones are copied tau by tau through a shuffle."""
    spark = packed.sparkSession
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if estimated_bytes(packed) > limit:
        return packed.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).repartition("tau")
    rows = spark.createDataFrame([(0, int(t)) for t in taus], "_one int, tau int").repartition("tau")
    return rows.join(packed, "_one")


def _percent(weighted: np.ndarray, rows: int) -> float:
    d = weighted.shape[-1]
    return float(100 * np.sqrt((weighted ** 2).sum() / (d * d * rows)))


@dataclass(frozen=True)
class MemoryModel:
    """The usual chain on one series: each step returns a table or a new model.

    The series, and the kernel once computed, are written to the shared folder: both are small
    and every later step reads them."""

    series: DataFrame
    dt: float = 1.0
    kernel: DataFrame | None = None
    kernel_steps: int = 0

    @classmethod
    def from_flat(cls, flat: DataFrame, n_lags: int, dimension: int, dt: float = 1.0
                  ) -> "MemoryModel":
        """From rows ``(k, m)``, row- or column-normalised, checked against the given sizes."""
        made = orient(unflatten(ingest_series(flat, n_lags, dimension)))
        return cls(materialise(made, "series"), dt)

    def derivative(self) -> DataFrame:
        return derivative(self.series, self.dt)

    def initial_rate(self) -> DataFrame:
        return initial_rate(self.series, self.dt)

    def with_kernel(self, steps: int = 10) -> "MemoryModel":
        kernel = materialise(memory_kernel(self.series, self.dt, steps), "kernel")
        return replace(self, kernel=kernel, kernel_steps=steps)

    def _need(self, steps: int) -> DataFrame:
        if self.kernel is None:
            raise ValueError("compute the kernel first (with_kernel)")
        if steps > self.kernel_steps:
            raise ValueError(f"the kernel has {self.kernel_steps} steps, {steps} are needed")
        return self.kernel

    def kernel_table(self) -> DataFrame:
        return kernel_table(self._need(1), self.dt)

    def mean_integral_kernel(self, steps: int) -> DataFrame:
        return mean_integral_kernel(self._need(steps), self.dt, steps)

    def predict(self, tau: int = 10, end: int = 100) -> DataFrame:
        return predict_memory(self.series, self._need(tau + 2), self.dt, tau, end)

    def predict_markov(self, tau: int = 10, end: int = 100, add_identity: bool = False,
                       compat: bool = False) -> DataFrame:
        return predict_markov(self.series, self.dt, tau, end, add_identity, compat)

    def comparison(self, tau: int, end: int, every: int = 10, diagonal: bool = True) -> DataFrame:
        return comparison_table(self.series, self.predict(tau, end),
                                self.predict_markov(tau, end), tau, every, diagonal)

    def rmse(self, end: int = 100, pi_step: int = 10, compat: bool = False) -> DataFrame:
        return rmse_sweep(self.series, self._need(end + 1), self.dt, end, pi_step, compat=compat)
