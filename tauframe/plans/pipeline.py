"""The usual chain from coordinates to a memory-kernel model, with tables in between.

Each stage that later stages read more than once is written to the shared folder: features,
discrete trajectories and the matrix series. Everything else stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tauframe.operators import clustering, counting, features, lumping, memory, reversible
from tauframe.operators import series as series_ops
from tauframe.operators import tica
from tauframe.session import materialise


@dataclass
class Model:
    dtraj: DataFrame          # microstates
    lumping: DataFrame        # microstate -> macrostate
    macro: DataFrame          # macrostate trajectories
    series: DataFrame         # macrostate matrices over lag
    kernel: DataFrame


def discretise(x: DataFrame, lag: int, n_components: int, n_clusters: int,
               columns: Sequence[int] | None = None, seed: int = 0) -> DataFrame:
    """Feature trajectories -> microstate trajectories ``(traj_id, frame, state)``."""
    if columns is not None:
        x = features.select_columns(x, columns)
    model = tica.fit_tica(x, lag, n_components)
    y = materialise(model.transform(x).select("traj_id", "frame", "y"), "projection")
    return clustering.k_centers(y, n_clusters, seed=seed).assigned.select(
        "traj_id", "frame", "state")


def macro_model(dtraj: DataFrame, micro_lag: int, n_macro: int, n_lags: int, dt: float,
                kernel_steps: int) -> Model:
    """Microstates -> trimmed counts -> lumping -> reversible macrostate series -> kernel."""
    counts = materialise(counting.count_transitions(dtraj, [micro_lag]), "counts")
    inside = reversible.between(counts, reversible.ergodic_states(counts))
    lumped = materialise(lumping.lump_states(inside, n_macro), "lumping")
    macro = lumping.apply_lumping(dtraj, lumped)
    made = materialise(series_ops.matrix_series(macro, n_lags, reversible="mle", trim=True), "series")
    return Model(dtraj, lumped, macro, made, memory.memory_kernel(made, dt, kernel_steps))
