"""Transition counts and the matrices made from them.

Everything after ``count_transitions`` works on coordinate rows ``(keys.., lag, i, j, n)``:
at most (number of states)^2 rows per model and lag, whatever the number of frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tauframe.operators.blocks import Block, encode, run_ids, sorted_blocks
from tauframe.operators.sequences import CHUNK_ROWS, check_lags, lagged_values, with_halo

WINDOW_LAGS = 8    # beyond this many lags one Arrow pass beats one window column per lag


def lagged_pairs(dtraj: DataFrame, lags: Sequence[int], traj: Sequence[str] = ("traj_id",),
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows ``(.., lag, i, j)``: state now and ``lag`` frames later."""
    return (lagged_values(dtraj, lags, "state", traj, chunk_rows)
            .withColumnRenamed("state", "i").withColumnRenamed("later", "j"))


def count_transitions(dtraj: DataFrame, lags: Sequence[int], keys: Sequence[str] = (),
                      traj: Sequence[str] = ("traj_id",), chunk_rows: int = CHUNK_ROWS,
                      method: str = "auto") -> DataFrame:
    """Sliding-window counts ``(keys.., lag, i, j, n)``.

    Few lags stay inside the JVM; a wide sweep runs one Arrow pass over sorted chunks. Both
    pre-aggregate before the last shuffle, so a frequent transition is not a hot key.
    """
    lags = check_lags(lags)
    keys = list(keys)
    if method == "auto":
        method = "window" if len(lags) <= WINDOW_LAGS else "arrow"
    if method == "window":
        return (lagged_pairs(dtraj, lags, traj, chunk_rows)
                .groupBy(*keys, "lag", "i", "j").agg(F.count(F.lit(1)).alias("n")))
    if method == "arrow":
        return _sweep_counts(dtraj, lags, keys, list(traj), chunk_rows)
    raise ValueError(f"unknown method {method!r}")


def _sweep_counts(dtraj, lags, keys, traj, chunk_rows):
    rows, part, at_home = with_halo(dtraj, max(lags), traj, chunk_rows)
    needed = list(dict.fromkeys([*part, *keys]))
    rows = (rows.where(F.col("state").isNotNull())
            .select(*needed, "frame", "state", at_home.alias("_own"))
            .repartition(*part).sortWithinPartitions(*part, "frame"))
    fields = {f.name: f for f in rows.schema.fields}
    state = fields["state"].dataType
    schema = T.StructType([*[T.StructField(k, fields[k].dataType) for k in keys],
                           T.StructField("lag", T.IntegerType()),
                           T.StructField("i", state), T.StructField("j", state),
                           T.StructField("n", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in sorted_blocks(batches, part, max(lags)):
            out = _count_block(block, lags, keys, arrow_schema)
            if out is not None:
                yield out

    return (rows.mapInArrow(run, schema)
            .groupBy(*keys, "lag", "i", "j").agg(F.sum("n").alias("n")))


def _count_block(block: Block, lags, keys, arrow_schema) -> pa.RecordBatch | None:
    states = encode(block.table["state"])
    code = states.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    d = len(states.dictionary)
    group = run_ids(block.table, keys)
    parts = []
    for tau in lags:
        src, dst = block.pairs(tau)
        if len(src):
            cell = (group[src] * d + code[src]) * d + code[dst]
            seen, n = np.unique(cell, return_counts=True)
            parts.append((np.full(len(seen), tau), seen, n))
    if not parts:
        return None
    lag, cell, n = (np.concatenate(x) for x in zip(*parts))
    first_of = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    owner = pa.array(first_of[cell // (d * d)])
    cols = [block.table[k].combine_chunks().take(owner) for k in keys]
    cols += [pa.array(lag, pa.int32()), states.dictionary.take(pa.array(cell // d % d)),
             states.dictionary.take(pa.array(cell % d)), pa.array(n, pa.int64())]
    cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
    cols = [c.cast(f.type) for c, f in zip(cols, arrow_schema)]
    return pa.RecordBatch.from_arrays(cols, schema=arrow_schema)


def symmetrise(counts: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """``(C + C^T) / 2`` as coordinate rows; ``n`` becomes DOUBLE."""
    keys = list(keys)
    both = F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")),
                             F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return (counts.select(*keys, both.alias("e"), "n")
            .groupBy(*keys, F.col("e.i").alias("i"), F.col("e.j").alias("j"))
            .agg((F.sum("n") / 2.0).alias("n")))


def row_normalise(counts: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """Adds ``p = n / (row sum)``. Rows without counts stay absent rather than becoming NaN."""
    row = Window.partitionBy(*keys, "i")
    return (counts.withColumn("_row", F.sum("n").over(row)).where(F.col("_row") > 0)
            .withColumn("p", F.col("n") / F.col("_row")).drop("_row"))


def transition_matrix(counts: DataFrame, keys: Sequence[str] = ("lag",),
                      reversible: str | None = None) -> DataFrame:
    """Transition probabilities; ``reversible`` is None, 'transpose' or 'mle'."""
    if reversible is None:
        return row_normalise(counts, keys)
    if reversible == "transpose":
        return row_normalise(symmetrise(counts, keys), keys)
    if reversible == "mle":
        from tauframe.operators.reversible import reversible_mle
        return reversible_mle(counts, keys)
    raise ValueError(f"unknown reversible estimator {reversible!r}")


def populations(sym_counts: DataFrame, keys: Sequence[str] = ("lag",)) -> DataFrame:
    """Stationary distribution of the transpose estimator: normalised row sums."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return (sym_counts.groupBy(*keys, "i").agg(F.sum("n").alias("_row"))
            .withColumn("p", F.col("_row") / F.sum("_row").over(whole)).drop("_row"))


def distinct_states(dtraj: DataFrame) -> DataFrame:
    return dtraj.select("state").where(F.col("state").isNotNull()).distinct()
