"""k-centers clustering and nearest-center assignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tauframe.functions.arrays import matrix_of
from tauframe.functions.hashing import key_digest
from tauframe.session import materialise

POOL_ROWS = 20_000   # far points looked at on the driver between two passes over the data
BINS = 16_384
CUT_EVERY = 16       # passes between two cuts of the lineage


@dataclass
class Clustering:
    """``centers`` (k x d, in the order found), their keys, and the assigned frames."""

    centers: np.ndarray
    keys: list[tuple]
    assigned: DataFrame      # traj_id, frame, state, distance

    def center_table(self, spark, run_id: str = "run") -> DataFrame:
        rows = [(run_id, s, *self.keys[s], self.centers[s].tolist())
                for s in range(len(self.centers))]
        traj = self.assigned.schema["traj_id"].dataType.simpleString()
        return spark.createDataFrame(
            rows, f"run_id string, state int, traj_id {traj}, frame bigint, y array<double>")


def _nearer(points: DataFrame, centers: np.ndarray, offset: int, fresh: bool) -> DataFrame:
    """Lower each point's distance and label by some more centers. Narrow, Arrow-batched."""
    schema = points.select("traj_id", "frame", "y").schema.add("distance", "double").add(
        "state", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix_of(batch.column("y"))
            if fresh:
                if not np.isfinite(y).all():
                    raise ValueError("a point has coordinates that are not finite; drop such frames first")
                best = np.full(len(y), np.inf)
                label = np.full(len(y), -1, dtype=np.int32)
            else:
                best = batch.column("distance").to_numpy(zero_copy_only=False).copy()
                label = batch.column("state").to_numpy(zero_copy_only=False).copy()
            for s, center in enumerate(centers):
                step = y - center
                d = np.sqrt(np.einsum("ij,ij->i", step, step))
                closer = d < best          # ties stay with the earlier center
                best[closer], label[closer] = d[closer], offset + s
            yield pa.RecordBatch.from_arrays(
                [batch.column("traj_id"), batch.column("frame"), batch.column("y"),
                 pa.array(best), pa.array(label, pa.int32())],
                names=["traj_id", "frame", "y", "distance", "state"])

    return points.mapInArrow(run, schema)


def assign_nearest(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``(traj_id, frame, state, distance)``: nearest of given centers for every frame."""
    return _nearer(points.select("traj_id", "frame", "y"), np.asarray(centers, float), 0,
                   True).drop("y")


def _far_points(state: DataFrame, upper: float) -> tuple[list, float]:
    """Rows that may be the next center, and a bound no other row exceeds.

    A histogram of distances (map-side combined) fixes a cut above which at most ``POOL_ROWS``
    rows lie, so the driver sees a bounded number of rows however many tie or cluster."""
    width = upper / BINS
    hist = (state.groupBy(F.least(F.floor(F.col("distance") / width), F.lit(BINS - 1)).alias("b"))
            .count().collect())
    above, cut = 0, None
    for row in sorted(hist, key=lambda r: -r["b"]):
        if above + row["count"] > POOL_ROWS:
            break
        above, cut = above + row["count"], row["b"] * width
    order = [F.desc("distance"), "traj_id", "frame"]
    if not above:
        # more rows than the pool holds share the top bin: take the exact farthest one
        top = state.orderBy(*order).limit(1).collect()
        return top, top[0]["distance"]
    # the cut is recomputed from the bin number, so rounding at its edge may move a row into
    # the pool or out of it; a row left out is still at most ``cut`` plus that rounding away
    got = state.where(F.floor(F.col("distance") / width) * width >= cut).collect()
    got.sort(key=lambda r: (-r["distance"], r["traj_id"], r["frame"]))
    return got, cut * (1 + 1e-12)


def k_centers(points: DataFrame, k: int, first: tuple | None = None, seed: int = 0) -> Clustering:
    """Gonzalez farthest-point clustering of ``(traj_id, frame, y ARRAY<DOUBLE>)``.

    Exact: every new center is the point farthest from all earlier ones (ties: smallest key).
    One pass over the data usually yields many centers. After a pass, the farthest points are
    kept on the driver with a bound on all others; distances only shrink, so as long as the
    best of the pool stays above the bound it is the global farthest point.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    points = points.select("traj_id", "frame", F.col("y").cast("array<double>").alias("y"))
    if first is None:
        start = points.orderBy(key_digest(seed, "traj_id", "frame"), "traj_id", "frame")
    else:
        start = points.where((F.col("traj_id") == first[0]) & (F.col("frame") == first[1]))
    row = start.limit(1).collect()
    if not row:
        raise ValueError("no points to cluster")
    centers, keys = [np.array(row[0]["y"])], [(row[0]["traj_id"], row[0]["frame"])]
    state = _nearer(points, np.array(centers), 0, True).persist(StorageLevel.MEMORY_AND_DISK)
    upper = state.agg(F.max("distance")).first()[0]
    passes, older = 1, None
    while len(centers) < k and upper > 0:
        pool, bound = _far_points(state, upper)
        if older is not None:
            older.unpersist()            # ``state`` has been computed from it by now
        y = np.array([r["y"] for r in pool])
        far = np.array([r["distance"] for r in pool])
        new: list[np.ndarray] = []
        while len(centers) + len(new) < k:
            at = int(far.argmax())           # pool is in (distance desc, key) order
            if far[at] == 0 or (new and far[at] <= bound):
                break
            new.append(y[at])
            keys.append((pool[at]["traj_id"], pool[at]["frame"]))
            upper = far[at]
            step = y - y[at]
            far = np.minimum(far, np.sqrt(np.einsum("ij,ij->i", step, step)))
        if not new:
            break
        older, state = state, _nearer(state, np.array(new), len(centers), False)
        centers += new
        passes += 1
        if passes % CUT_EVERY == 0:
            state = materialise(state, "kcenters")
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
    # what is handed on is written; the cached passes are not needed any more
    assigned = materialise(state.drop("y"), "kcenters")
    for used in (state, older):
        if used is not None:
            used.unpersist()
    return Clustering(np.array(centers), keys, assigned)


def sweep(settings: DataFrame, run) -> dict:
    """Run each distinct setting once; settings that agree share the result.

    ``settings`` is the small parameter table of ``plans.settings``; ``run`` maps one distinct
    parameter tuple to a result."""
    cols = [c for c in settings.columns if c not in ("parameter", "value", "run_id")]
    done: dict = {}
    out = {}
    for row in settings.collect():
        key = tuple(row[c] for c in cols)
        if key not in done:
            done[key] = run(**dict(zip(cols, key)))
        out[(row["parameter"], row["value"])] = done[key]
    return out
