"""Reversible estimation and ergodic trimming of count matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tauframe.functions import dense
from tauframe.operators.grouped import field_type, per_model
from tauframe.session import materialise


def reversible_mle(counts: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """Reversible maximum-likelihood ``(keys.., i, j, n, p, pi)``; ``n`` are the raw counts."""
    state = field_type(counts, "i")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c, states = dense.square(pdf, "n")
        flux = dense.fit_reversible(c)
        pi = flux.sum(axis=1)
        out = dense.long_form(dense.rows_to_one(flux)[None], states, "p")
        out["n"] = c.reshape(-1)
        out["pi"] = np.repeat(pi, len(states))
        return out[(flux.reshape(-1) > 0)]

    return per_model(counts, keys, fit, [("i", state), ("j", state), ("n", T.DoubleType()),
                                         ("p", T.DoubleType()), ("pi", T.DoubleType())])


def ergodic_states(counts: DataFrame, keys: Sequence[str] = ("lag",),
                   cutoff: float = 0.0) -> DataFrame:
    """States of the largest strongly connected set and their new numbers
    ``(keys.., state, new_state)``. Only transitions with more than ``cutoff`` counts connect."""
    state = field_type(counts, "i")

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        c, states = dense.square(pdf, "n")
        kept = [s for s, keep in zip(states, dense.largest_connected(c, cutoff)) if keep]
        return pd.DataFrame({"state": kept, "new_state": range(len(kept))})

    return per_model(counts, keys, trim, [("state", state), ("new_state", T.IntegerType())])


def common_states(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., state)``: states that belong to the largest strongly connected set at every lag of
    their model. What one lag loses may cut another lag's set, so the search is repeated on what
    is left until it loses nothing. ``counts`` (keys.., lag, i, j, n) is read once per round and should
    be a written table; one task holds the counts of one model at one lag."""
    keys = list(keys)
    lags = counts.groupBy(*keys).agg(F.count_distinct("lag").alias("_lags"))
    everywhere = F.col("_in") == (F.col("_lags") if keys else F.lit(lags.first()[0]))
    left, before = counts, None
    while True:
        found = ergodic_states(left, [*keys, "lag"]).groupBy(*keys, "state").agg(F.count("lag").alias("_in"))
        found = found.join(lags, keys) if keys else found
        kept = materialise(found.where(everywhere).select(*keys, "state"), "states")
        size = kept.count()
        if size == before:
            return kept
        if not size and not counts.isEmpty():
            raise ValueError("no state is connected both ways at every lag")
        left, before = between(counts, kept, keys), size


def between(counts: DataFrame, kept: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """Counts between kept states, which keep their names."""
    keys = list(keys)
    for end in ("i", "j"):
        counts = counts.join(kept.select(*keys, F.col("state").alias(end)), [*keys, end], "left_semi")
    return counts


def trimmed_states(counts: DataFrame, kept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., lag, state, n)``: states that ``kept`` lacks, and the counts each loses at each lag
    (to, from and at it)."""
    keys = list(keys)
    ends = F.explode(F.array_distinct(F.array("i", "j"))).alias("state")
    lost = counts.select(*keys, "lag", ends, "n").join(kept, [*keys, "state"], "left_anti")
    return lost.groupBy(*keys, "lag", "state").agg(F.sum("n").alias("n"))


def trim_counts(counts: DataFrame, keep: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """Counts between kept states, in the new numbering."""
    keys = list(keys)
    a = keep.select(*keys, F.col("state").alias("i"), F.col("new_state").alias("_i"))
    b = keep.select(*keys, F.col("state").alias("j"), F.col("new_state").alias("_j"))
    return (counts.join(a, [*keys, "i"]).join(b, [*keys, "j"])
            .select(*keys, F.col("_i").alias("i"), F.col("_j").alias("j"), "n"))


def drop_state(matrix: DataFrame, state) -> DataFrame:
    """Delete one state's row and column."""
    return matrix.where((F.col("i") != F.lit(state)) & (F.col("j") != F.lit(state)))


def clip_negative(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("p", F.greatest("p", F.lit(0.0)))


def transpose(matrix: DataFrame) -> DataFrame:
    return (matrix.withColumn("_i", F.col("j")).withColumn("j", F.col("i"))
            .withColumn("i", F.col("_i")).drop("_i"))
