"""Several k-centers clusterings of the same frames in one series of passes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tauframe.functions.arrays import matrix_of, rows_of
from tauframe.functions.hashing import key_digest
from tauframe.operators import clustering
from tauframe.session import materialise


@dataclass(frozen=True)
class Run:
    """``k`` centers in the first ``width`` entries of the coordinate column ``column``."""

    column: str
    width: int
    k: int


@dataclass
class Found:
    """Centers and their keys by run, the labels of all runs, and how often the frames were read."""

    centers: dict[str, np.ndarray]
    keys: dict[str, list[tuple]]
    assigned: DataFrame      # run_id, traj_id, frame, state, distance
    passes: int


def _nearer(points: DataFrame, runs: Sequence[Run], new: Sequence[np.ndarray], offsets: Sequence[int],
            fresh: bool) -> DataFrame:
    """Lower every run's distance and label of each point by that run's new centers."""
    columns = list(dict.fromkeys(r.column for r in runs))
    schema = T.StructType([*points.select("traj_id", "frame", *columns).schema,
                           T.StructField("distance", T.ArrayType(T.DoubleType())),
                           T.StructField("state", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = {c: matrix_of(batch.column(c)) for c in columns}
            if fresh:
                for c in columns:
                    if not np.isfinite(y[c]).all():
                        raise ValueError("a point has coordinates that are not finite; drop such frames first")
                best = np.full((batch.num_rows, len(runs)), np.inf)
                label = np.full(best.shape, -1, np.int32)
            else:
                best = matrix_of(batch.column("distance")).copy()
                label = matrix_of(batch.column("state")).astype(np.int32)
            for r, (setting, centers) in enumerate(zip(runs, new)):
                own = y[setting.column][:, :setting.width]
                for s, center in enumerate(centers):
                    step = own - center
                    d = np.sqrt(np.einsum("ij,ij->i", step, step))
                    closer = d < best[:, r]          # ties stay with the earlier center
                    best[closer, r], label[closer, r] = d[closer], offsets[r] + s
            yield pa.RecordBatch.from_arrays(
                [batch.column("traj_id"), batch.column("frame"), *[batch.column(c) for c in columns],
                 rows_of(best), rows_of(label)], names=[f.name for f in schema])

    return points.mapInArrow(run, schema)


def _pick(values: Sequence, run: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), run + 1)


def _pools(state: DataFrame, runs: Sequence[Run], open_: Sequence[int], upper: Sequence[float]) -> dict[int, tuple[list, float]]:
    """For each open run the rows that may be its next centers, and a bound no other row exceeds.

    One histogram of all runs' distances sets the cuts; together the pools hold at most
    ``clustering.POOL_ROWS`` rows."""
    each, bins = clustering.POOL_ROWS // len(open_), clustering.BINS
    width = [u / bins if k in open_ else 1.0 for k, u in enumerate(upper)]
    long = state.select("traj_id", "frame", *[r for r in dict.fromkeys(runs[k].column for k in open_)],
                        F.posexplode("distance").alias("run", "d")).where(F.col("run").isin(list(open_)))
    # the width is rounded the same way in both uses
    long = long.withColumn("b", F.floor(F.col("d") / _pick(width, F.col("run"))))
    hist = long.groupBy("run", F.least("b", F.lit(bins - 1)).alias("b")).count().collect()
    cut: dict[int, int] = {}
    for k in open_:
        above = 0
        for row in sorted((h for h in hist if h["run"] == k), key=lambda h: -h["b"]):
            above += row["count"]
            if above > each:
                break
            cut[k] = row["b"]
    y = F.coalesce(*[F.when(F.col("run") == k, F.slice(runs[k].column, 1, runs[k].width)) for k in open_])
    wide = long.select("run", "traj_id", "frame", "d", "b", y.alias("y"))
    edges = _pick([cut.get(k, bins * 2) for k in range(len(runs))], F.col("run"))
    rows: dict[int, list] = {k: [] for k in open_}
    if cut:
        for r in wide.where(F.col("b") >= edges).collect():
            rows[r["run"]].append(r)
    out = {}
    for k in open_:
        if k in cut:
            rows[k].sort(key=lambda r: (-r["d"], r["traj_id"], r["frame"]))
            out[k] = rows[k], cut[k] * width[k] * (1 + 1e-12)
        else:    # more rows than the pool holds share the top bin: take the exact farthest one
            top = wide.where(F.col("run") == k).orderBy(F.desc("d"), "traj_id", "frame").limit(1).collect()
            out[k] = top, top[0]["d"]
    return out


def _grow(pool: list, bound: float, room: int) -> tuple[list[np.ndarray], list[tuple], float]:
    """Centers that a pool settles: as long as its best stays above the bound on all other points."""
    y, far = np.array([r["y"] for r in pool]), np.array([r["d"] for r in pool])
    new, keys, upper = [], [], 0.0
    while len(new) < room:
        at = int(far.argmax())
        if far[at] == 0 or (new and far[at] <= bound):
            break
        new.append(y[at])
        keys.append((pool[at]["traj_id"], pool[at]["frame"]))
        upper = far[at]
        step = y - y[at]
        far = np.minimum(far, np.sqrt(np.einsum("ij,ij->i", step, step)))
    return new, keys, upper


def k_centers_many(points: DataFrame, runs: Mapping[str, Run], seed: int = 0) -> Found:
    """Farthest-point clustering for every run, each equal to ``clustering.k_centers`` of its own.

    A point carries one distance and one label per run. A pass over the points lowers all of them
    and finds every run's next far points, so all runs together take as many passes as the longest
    one alone. Runs that have their centers, or no point off them, take no part any more."""
    if not runs or any(r.k < 1 for r in runs.values()):
        raise ValueError("every run needs at least one center")
    names, settings = list(runs), list(runs.values())
    columns = list(dict.fromkeys(r.column for r in settings))
    points = points.select("traj_id", "frame", *[F.col(c).cast("array<double>").alias(c) for c in columns])
    first = points.orderBy(key_digest(seed, "traj_id", "frame"), "traj_id", "frame").limit(1).collect()
    if not first:
        raise ValueError("no points to cluster")
    centers = [[np.array(first[0][r.column][:r.width])] for r in settings]
    keys = [[(first[0]["traj_id"], first[0]["frame"])] for _ in settings]
    state = _nearer(points, settings, [np.array(c) for c in centers], [0] * len(settings), True).persist(
        StorageLevel.MEMORY_AND_DISK)
    upper = list(state.agg(*[F.max(F.col("distance")[k]) for k in range(len(settings))]).first())
    passes, older = 1, None
    while True:
        open_ = [k for k, r in enumerate(settings) if len(centers[k]) < r.k and upper[k] > 0]
        if not open_:
            break
        pools = _pools(state, settings, open_, upper)
        if older is not None:
            older.unpersist()            # ``state`` has been computed from it by now
        new: list[list[np.ndarray]] = [[] for _ in settings]
        for k, (pool, bound) in pools.items():
            new[k], found, upper[k] = _grow(pool, bound, settings[k].k - len(centers[k]))
            keys[k] += found
        older, state = state, _nearer(state, settings, new, [len(c) for c in centers], False)
        for k in open_:
            centers[k] += new[k]
        passes += 1
        if passes % clustering.CUT_EVERY == 0:
            state = materialise(state, "kcenters")
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
    each = F.posexplode(F.arrays_zip("distance", "state")).alias("_r", "_v")
    assigned = materialise(state.select("traj_id", "frame", each).select(
        _pick(names, F.col("_r")).alias("run_id"), "traj_id", "frame", "_v.state", "_v.distance"), "kcenters")
    for used in (state, older):
        if used is not None:
            used.unpersist()
    return Found({n: np.array(c) for n, c in zip(names, centers)}, dict(zip(names, keys)), assigned, passes)
