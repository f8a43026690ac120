"""Series of transition matrices over lag time: ``(keys.., k, i, j, p)``.

Step ``k`` (0-based) is the matrix at lag ``(k + 1) * dt``; the integer step is the key and
times are derived from it, so no comparison depends on accumulated floats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tauframe.operators.counting import count_transitions, transition_matrix
from tauframe.operators.reversible import between, common_states
from tauframe.session import materialise


def lag_steps(first: float, last: float, step: float, timestep: float) -> tuple[int, int, int]:
    """``(n_lags, stride, start)`` in frames for lag times first, first + step, .. last."""
    stride, start = round(step / timestep), round(first / timestep)
    if stride < 1 or start < 1:
        raise ValueError("lag times must be at least one time step apart")
    return (round(last / timestep) - start) // stride + 1, stride, start


def matrix_series(dtraj: DataFrame, n_lags: int, stride: int = 1, reversible: str | None = None,
                  keys: Sequence[str] = (), start: int | None = None, trim: bool = False) -> DataFrame:
    """Transition matrices at ``n_lags`` lags ``start, start + stride, ..`` (start = stride
    unless given), zeros included. A lag that no pair of frames has is an error when it is read.

    ``trim`` keeps the states that are connected both ways at every lag (``trimmed_states`` reports
    the others); without it, a reversible fit of one-way counts is an error."""
    keys = list(keys)
    start = stride if start is None else start
    counts = count_transitions(dtraj, [start + stride * k for k in range(n_lags)],
                               keys=keys, traj=[*keys, "traj_id"])
    if trim:
        counts = materialise(counts, "counts")
        counts = between(counts, common_states(counts, keys), keys)
    tpm = transition_matrix(counts, [*keys, "lag"], reversible)
    step = ((F.col("lag") - start) / stride).cast("int")
    return fill_cells(materialise(tpm.select(*keys, step.alias("k"), "i", "j", "p"), "series"), keys, n_lags)


def fill_cells(series: DataFrame, keys: Sequence[str] = (), n_lags: int | None = None) -> DataFrame:
    """Add absent cells as zeros, over the states that any step of the model has. A model that lacks
    one of the steps 0 .. n_lags - 1 (up to its last one, unless given) is an error.

    The grid is built from one row per model that names its states and steps, so steps are filled in
    parallel. ``series`` is read twice and should be a written table."""
    keys = list(keys)
    names = series.groupBy(*keys).agg(
        F.array_union(F.collect_set("i"), F.collect_set("j")).alias("_s"), F.collect_set("k").alias("_k"))
    wanted = F.lit(n_lags) if n_lags else F.array_max("_k") + 1
    lacking = F.array_except(F.sequence(F.lit(0), wanted - 1), "_k")
    told = F.raise_error(F.concat(F.lit("no pair of frames at lag steps "), F.array_join(F.slice(lacking, 1, 10), ", ")))
    steps = F.when(F.size("_k") == 0, F.array().cast("array<int>")).when(
        F.size(lacking) > 0, told.cast("array<int>")).otherwise(F.col("_k"))
    grid = names.select(*keys, "_s", F.explode(steps).alias("k")).repartition(*keys, "k")
    grid = grid.select(*keys, "k", "_s", F.explode("_s").alias("i")).select(*keys, "k", "i", F.explode("_s").alias("j"))
    g, s = grid.alias("g"), series.alias("s")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys] + [F.col(f"g.{c}") == F.col(f"s.{c}") for c in "kij"]
    return g.join(s, same, "left").select(*[f"g.{c}" for c in keys], "g.k", "g.i", "g.j",
                                          F.coalesce("s.p", F.lit(0.0)).alias("p"))


def lag_time(k: str | Column, dt: float) -> Column:
    k = F.col(k) if isinstance(k, str) else k
    return (k + 1) * F.lit(float(dt))


def derivative(series: DataFrame, dt: float, keys: Sequence[str] = ()) -> DataFrame:
    """Forward difference ``(p[k+1] - p[k]) / dt``; the last step has none."""
    by = Window.partitionBy(*keys, "i", "j").orderBy("k")
    return (series.withColumn("_next", F.lead("p").over(by)).where(F.col("_next").isNotNull())
            .select(*keys, "k", "i", "j", ((F.col("_next") - F.col("p")) / dt).alias("dp")))


def normalisation(series: DataFrame, keys: Sequence[str] = (), tol: float = 1e-3) -> DataFrame:
    """``(keys.., row_ok, col_ok)``: does every row, or every column, of every step sum to 1?"""
    keys = list(keys)
    ends = F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("i").alias("state")),
                             F.struct(F.lit("col").alias("axis"), F.col("j").alias("state"))))
    sums = (series.select(*keys, "k", "p", ends.alias("_e")).groupBy(*keys, "k", "_e")
            .agg((F.abs(F.sum("p") - 1) < tol).alias("_ok")))
    on = lambda axis: F.bool_and(F.when(F.col("_e.axis") == axis, F.col("_ok")))
    return sums.groupBy(*keys).agg(on("row").alias("row_ok"), on("col").alias("col_ok"))


def orient(series: DataFrame, keys: Sequence[str] = (), tol: float = 1e-3) -> DataFrame:
    """Row-normalised form of a row- or column-normalised series; anything else is an error."""
    keys = list(keys)
    model = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    off = lambda axis: F.abs(F.sum("p").over(Window.partitionBy(*keys, "k", axis)) - 1)
    fail = F.raise_error("transition matrices are neither row nor column normalised")
    swap = (F.when(F.max("_off_i").over(model) < tol, F.lit(False))
            .when(F.max("_off_j").over(model) < tol, F.lit(True)).otherwise(fail.cast("boolean")))
    return (series.withColumn("_off_i", off("i")).withColumn("_off_j", off("j"))
            .withColumn("_swap", swap)
            .select(*keys, "k", F.when(F.col("_swap"), F.col("j")).otherwise(F.col("i")).alias("i"),
                    F.when(F.col("_swap"), F.col("i")).otherwise(F.col("j")).alias("j"), "p"))


def flatten(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., k, m ARRAY<DOUBLE>)``, row-major over sorted states."""
    return (series.groupBy(*keys, "k")
            .agg(F.array_sort(F.collect_list(F.struct("i", "j", "p"))).alias("_cells"))
            .select(*keys, "k", F.transform("_cells", lambda c: c["p"]).alias("m")))


def unflatten(flat: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse of ``flatten`` with states numbered 0..d-1; d^2 must be a perfect square."""
    side = F.sqrt(F.size("m")).cast("int")
    checked = F.when(side * side == F.size("m"), side).otherwise(
        F.raise_error("matrix row length is not a square number").cast("int"))
    return (flat.withColumn("_d", checked)
            .select(*keys, "k", "_d", F.posexplode("m").alias("_pos", "p"))
            .select(*keys, "k", F.floor(F.col("_pos") / F.col("_d")).cast("int").alias("i"),
                    (F.col("_pos") % F.col("_d")).alias("j"), "p"))


def with_time(flat: DataFrame, dt: float, keys: Sequence[str] = ()) -> DataFrame:
    """Timed rows: the time goes in front of each flattened matrix."""
    time = (F.col("k") * F.lit(float(dt))).alias("time")
    return flat.select(*keys, "k", F.concat(F.array(time), F.col("m")).alias("row"))


def last_matrix(series: DataFrame, keys: Sequence[str] = (), value: str = "p") -> DataFrame:
    """The matrix with the largest step."""
    return series.groupBy(*keys, "i", "j").agg(F.max_by(value, "k").alias(value))
