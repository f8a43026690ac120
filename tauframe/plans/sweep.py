"""Settings compared by cross-validated scores: features, projection, clustering, one model each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tauframe.operators import covariance, spectrum, tica
from tauframe.operators.many_centers import Found, Run, k_centers_many
from tauframe.session import materialise


@dataclass
class Sweep:
    found: Found
    scores: DataFrame        # run_id, repeat, fold, train_score, test_score
    summary: DataFrame       # parameter, value, run_id, medians, quartiles, means


def project_settings(x: DataFrame, settings: DataFrame, seed: int = 0) -> tuple[DataFrame, dict[str, Run]]:
    """Frames projected for every (no_features, tica_lagtime) of ``settings``, and the runs on them.

    Moments of all lags come from one pass over the frames, all projections from another. What the
    driver holds is d x d per lag, never frames."""
    rows = settings.select("run_id", "no_features", "no_components", "no_clusters", "tica_lagtime").distinct().collect()
    lags = sorted({r.tica_lagtime for r in rows})
    moments = materialise(covariance.lagged_moments(x, lags), "moments")
    chosen = {}
    for r in tica.select_features(moments, sorted({r.no_features for r in rows}), seed).orderBy("rank").collect():
        chosen.setdefault((r.n_cols, r.lag), []).append(r.feature_id)
    pdf = moments.toPandas()
    models, runs = {}, {}
    for n_features, lag in sorted({(r.no_features, r.tica_lagtime) for r in rows}):
        wanted = max(r.no_components for r in rows if (r.no_features, r.tica_lagtime) == (n_features, lag))
        m, columns = covariance.assemble(pdf[pdf.lag == lag]), chosen[n_features, lag]
        lam, v = tica.solve(m, columns=columns)
        if len(lam) < wanted:
            raise ValueError(f"{n_features} features span {len(lam)} components, fewer than the {wanted} asked for")
        vectors = np.zeros((len(m.mean), wanted))
        vectors[columns] = v[:, :wanted]
        models[f"y{n_features}_{lag}"] = tica.TicaModel(lag, m.mean, vectors, lam[:wanted], kinetic=True)
    y = x.select("traj_id", "frame", *[model.expression("x").alias(name) for name, model in models.items()])
    for r in rows:
        runs[r.run_id] = Run(f"y{r.no_features}_{r.tica_lagtime}", r.no_components, r.no_clusters)
    return materialise(y, "projection"), runs


def score_settings(x: DataFrame, settings: DataFrame, lag: int, repeats: int = 10, folds: int = 6,
                   n_timescales: int = 3, seed: int = 0) -> Sweep:
    """Cluster and score every setting of ``settings`` (``plans.settings.one_at_a_time``). Settings that
    agree share one run; all runs are clustered in the same passes and scored in one job on the
    same splits."""
    y, runs = project_settings(x, settings, seed)
    found = k_centers_many(y, runs, seed)
    scores = spectrum.cross_validate(found.assigned.select("run_id", "traj_id", "frame", "state"), lag, repeats, folds,
                                     n_timescales, seed, keys=["run_id"])
    scores = materialise(scores, "scores")
    named = settings.select("parameter", "value", "run_id")
    return Sweep(found, scores, named.join(spectrum.score_summary(scores, ["run_id"]), "run_id"))
