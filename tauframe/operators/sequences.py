"""Ordering, ranking and lagging rows of trajectories.

Contract: a trajectory table has ``traj_id``, ``frame`` (BIGINT, 0-based, unique inside its
trajectory) and payload columns. A lagged pair never crosses trajectories, and none of these
operators puts a whole trajectory into one task:

* ``index_frames`` cuts large tables into cells of like size by their keys and adds prefix sums;
* ``with_halo`` cuts every trajectory into chunks of fixed length, each carrying the few rows
  that follow it, so one shuffle on (trajectory, chunk) serves every lag of a sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tauframe.functions.hashing import digest_bucket
from tauframe.session import materialise

HOT_ROWS = 4_000_000     # longest run of rows ranked inside one task
SMALL_BYTES = 8 << 20    # tables estimated below this are ranked without counting their rows
CHUNK_ROWS = 1 << 16     # frames in one chunk of a trajectory
RANK_ROWS = 1_000_000    # rows of one group ranked by one task


def ranked(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str],
           name: str) -> DataFrame:
    """0-based rank of each row inside ``group``, computed per (group, bucket).

    ``bucket`` must be monotone in ``order``. A group of any size is spread over its buckets:
    rows are ranked inside their bucket and shifted by the number of rows in earlier buckets.
    """
    group = list(group)
    local = Window.partitionBy(*group, bucket).orderBy(*order)
    earlier = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
        bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .drop("_n"))
    return (df.withColumn("_rn", F.row_number().over(local) - 1)
            .join(offsets, [*group, bucket], "left")
            .withColumn(name, (F.col("_rn") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
            .drop("_rn", "_offset"))


def cells(df: DataFrame, traj: str, order_by: Sequence[str], payload: Sequence[str | Column],
          parts: int, cut_rows: int | None = None) -> DataFrame:
    """``(traj_id, _o0, .., _tie, *payload, _cell)``, saved: rows range-partitioned by trajectory and
    full order key, so partitions hold like numbers of rows whatever the keys look like (outliers, ties
    in the first key, strings). A hash of the row splits ties of the whole key. A partition is a cell;
    with ``cut_rows`` it is sorted and cut into cells of so many rows, at no task per cell."""
    keys = [F.col(c).alias(f"_o{k}") for k, c in enumerate(order_by)]
    rows = df.select(F.col(traj).alias("traj_id"), *keys, *payload)
    hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = rows.withColumn("_tie", F.xxhash64(*hashed))
    order = ["traj_id", *(f"_o{k}" for k in range(len(order_by))), "_tie"]
    spread = rows.repartitionByRange(parts, *order)
    if cut_rows is None:
        return materialise(spread.withColumn("_cell", F.spark_partition_id()), "cells")
    # the id is the partition and, below 2^33, the place in it
    placed = spread.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id") % 2**33
    return materialise(placed.withColumn("_cell", F.col("_id") - place + F.floor(place / cut_rows)).drop("_id"), "cells")


def missing_keys(df: DataFrame, traj: str, order_by: Sequence[str]) -> DataFrame:
    """``(reason, n)``: rows that ``index_frames`` leaves out, by the first of their keys that is NULL."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in (traj, *order_by)])
    return (df.select(reason.alias("reason")).where("reason is not null")
            .groupBy("reason").agg(F.count("*").alias("n")))


def index_frames(df: DataFrame, traj: str, order_by: Sequence[str], payload: Sequence[str | Column],
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``(traj_id, frame, *payload)``: position of every row inside its trajectory.

    Tables that the planner estimates below ``SMALL_BYTES`` hold no trajectory too long for a task:
    one shuffle, and no job while the plan is built. Larger ones are counted; above ``hot_rows``
    rows they are cut into ``cells`` of about that many rows, ranked cell by cell and shifted by
    what earlier cells hold, so a trajectory with a third of the table is ranked by many tasks.
    ``hot_rows=None`` never cuts; a smaller ``hot_rows`` than the default always counts. Rows
    without a trajectory or an order key are left out (``missing_keys`` counts them).
    """
    order_by = list(order_by)
    rows = df
    for name in (traj, *order_by):
        rows = rows.where(F.col(name).isNotNull())      # unlike dropna, this reaches the scan
    total = 0
    if hot_rows is not None and (hot_rows < HOT_ROWS or estimated_bytes(df) > SMALL_BYTES):
        total = df.count()
    if hot_rows is None or total <= hot_rows:
        by = Window.partitionBy(traj).orderBy(*order_by)
        frame = (F.row_number().over(by) - 1).cast("bigint")
        return rows.select(F.col(traj).alias("traj_id"), frame.alias("frame"), *payload)
    n_cells = -(-total // hot_rows)
    # a task, and a sample sent to the driver, per partition: small cells share partitions
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(n_cells, max(-(-total // HOT_ROWS), shuffle))
    saved = cells(rows, traj, order_by, payload, parts, hot_rows if parts < n_cells else None)
    keys = [*(f"_o{k}" for k in range(len(order_by))), "_tie"]
    return ranked(saved, ["traj_id"], "_cell", keys, "frame").select(
        "traj_id", "frame", *[c for c in saved.columns if c not in ("traj_id", "_cell", *keys)])


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate; for a written table, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_rank(df: DataFrame, group: Sequence[str], digest: Column, ties: Sequence[str],
              name: str, group_rows: int | None = None) -> DataFrame:
    """0-based rank in the order of a digest. Digests are uniform, so their leading bits split
    every group evenly; groups known to have at most ``RANK_ROWS`` rows are ranked whole."""
    with_digest = df.withColumn("_digest", digest)
    if group_rows is not None and group_rows <= RANK_ROWS:
        by = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(
            "_digest", *ties)
        rank = (F.row_number().over(by) - 1).cast("bigint")
        return with_digest.withColumn(name, rank).drop("_digest")
    bucketed = with_digest.withColumn("_bucket", digest_bucket(F.col("_digest")))
    return ranked(bucketed, group, "_bucket", ["_digest", *ties], name).drop("_digest", "_bucket")


def with_halo(frames: DataFrame, span: int, traj: Sequence[str] = ("traj_id",),
              chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, list[str], Column]:
    """Assign rows to chunks and copy the first ``span`` frames of a chunk to the one before.

    Returns the rows, the columns to partition by, and the predicate "this row is at home"
    (not a copy). Chunks are at least four spans long, so copies add at most a quarter.
    """
    size = max(int(chunk_rows), 4 * int(span), 1)
    home = F.floor(F.col("frame") / size)
    copy = (F.col("frame") % size < span) & (home > 0)
    rows = (frames.withColumn("_home", home)
            .withColumn("_chunk", F.explode(F.when(copy, F.array(home, home - 1))
                                            .otherwise(F.array(home)))))
    return rows, [*traj, "_chunk"], F.col("_home") == F.col("_chunk")


def lagged_values(frames: DataFrame, lags: Sequence[int], value: str,
                  traj: Sequence[str] = ("traj_id",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per (row, lag) whose partner ``frame + lag`` exists: adds ``lag``, ``later``.

    All lags share one window. The frame is a RANGE of exactly ``lag``, so a missing frame
    drops its pairs instead of shifting them.
    """
    lags = check_lags(lags)
    rows, part, at_home = with_halo(frames, max(lags), traj, chunk_rows)
    by = Window.partitionBy(*part).orderBy("frame")
    ahead = [F.struct(F.lit(tau).alias("lag"),
                      F.first(value).over(by.rangeBetween(tau, tau)).alias("later"))
             for tau in lags]
    return (rows.withColumn("_ahead", F.array(*ahead))
            .where(at_home)
            .withColumn("_pair", F.explode("_ahead"))
            .where(F.col("_pair.later").isNotNull() & F.col(value).isNotNull())
            .withColumn("lag", F.col("_pair.lag"))
            .withColumn("later", F.col("_pair.later"))
            .drop("_home", "_chunk", "_ahead", "_pair"))


def check_lags(lags: Sequence[int]) -> list[int]:
    out = sorted({int(x) for x in lags})
    if not out or out[0] < 1:
        raise ValueError("lags must be positive whole numbers of frames")
    return out


def every_nth(frames: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """Keep frames ``offset, offset + step, ...`` of each trajectory."""
    if step < 1:
        raise ValueError("step must be at least 1")
    return frames.where(F.col("frame") % step == offset % step)


def state_positions(dtraj: DataFrame, state) -> DataFrame:
    """Keys of the frames that are in ``state``."""
    return dtraj.where(F.col("state") == F.lit(state)).select("traj_id", "frame")


def align_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row-for-row alignment of two per-frame tables, by key rather than by position.

    The key is (trajectory, frame), so no trajectory is a hot key."""
    return left.join(right, ["traj_id", "frame"], "inner")
