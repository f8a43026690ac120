"""Seeded sampling of frames from states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tauframe.functions.hashing import digest_bucket, digest_int, key_digest
from tauframe.session import materialise


DIGITS = 3          # hexadecimal digits of a bucket; more are used where buckets would be too long
BUCKET_ROWS = 1_000_000


def sample_states(dtraj: DataFrame, n: int = 10, seed: int = 0, replace: bool = True) -> DataFrame:
    """``(state, sample_no, traj_id, frame)``: ``n`` frames of each state.

    Frames of a state are ranked by a hash of (seed, key). With replacement, sample ``s`` is the frame
    of a rank drawn by (seed, state, s): the frames' hashes are counted by their leading digits,
    which tells the bucket of each drawn rank, and only those buckets are ranked. So each frame is
    hashed once a pass, whatever ``n`` is, and a state that holds most frames is no group of its own.
    Without replacement it is the ``n`` smallest hashes; the row-number limit is applied before the
    shuffle as well.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = dtraj.where(F.col("state").isNotNull()).select(
        "state", "traj_id", "frame", key_digest(seed, "traj_id", "frame").alias("_h"))
    if replace:
        return _drawn(rows, n, seed)
    by = Window.partitionBy("state").orderBy("_h", "traj_id", "frame")
    return (rows.withColumn("sample_no", F.row_number().over(by))
            .where(F.col("sample_no") <= n)
            .select("state", (F.col("sample_no") - 1).alias("sample_no"), "traj_id", "frame"))


def _drawn(rows: DataFrame, n: int, seed: int) -> DataFrame:
    digits = DIGITS
    while True:
        bucketed = rows.withColumn("_b", digest_bucket(F.col("_h"), digits))
        held = materialise(bucketed.groupBy("state", "_b").agg(F.count(F.lit(1)).alias("_n")), "buckets")
        longest = held.agg(F.max("_n")).first()[0] or 0
        if longest <= BUCKET_ROWS or digits >= 11:
            break
        digits += 2
    state = Window.partitionBy("state").orderBy("_b")
    ends = held.select("state", "_b", (F.sum("_n").over(state) - F.col("_n")).alias("_at"))
    draws = held.groupBy("state").agg(F.sum("_n").alias("_all")).select(
        "state", "_all", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample_no"))
    draws = draws.select("state", "sample_no", F.pmod(
        digest_int(key_digest(seed, "state", "sample_no")), F.col("_all")).alias("_at"))
    # the bucket of a rank is the last one that begins at or before it; beginnings come first
    both = ends.withColumn("sample_no", F.lit(None).cast("int")).unionByName(
        draws.withColumn("_b", F.lit(None).cast("bigint")))
    upto = Window.partitionBy("state").orderBy("_at", F.asc_nulls_first("sample_no")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    wanted = (both.withColumn("_bucket", F.last("_b", ignorenulls=True).over(upto))
              .withColumn("_rank", F.col("_at") - F.last(F.when(F.col("_b").isNotNull(), F.col("_at")),
                                                         ignorenulls=True).over(upto))
              .where(F.col("sample_no").isNotNull())
              .select("state", F.col("_bucket").alias("_b"), "_rank", "sample_no"))
    wanted = _saved(wanted)
    inside = Window.partitionBy("state", "_b").orderBy("_h", "traj_id", "frame")
    ranked = (bucketed.join(wanted.select("state", "_b").distinct(), ["state", "_b"], "left_semi")
              .withColumn("_rank", (F.row_number().over(inside) - 1).cast("bigint")))
    return ranked.join(wanted, ["state", "_b", "_rank"]).select("state", "sample_no", "traj_id", "frame")


def pick_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``frames`` named by ``wanted`` (traj_id, frame), each once."""
    return frames.join(_saved(wanted.select("traj_id", "frame").distinct()),
                       ["traj_id", "frame"], "left_semi")


def sampled_structures(frames: DataFrame, samples: DataFrame) -> DataFrame:
    """Manifest rows with the coordinates of the sampled frames attached."""
    return frames.join(_saved(samples), ["traj_id", "frame"])


def _saved(keys: DataFrame) -> DataFrame:
    """A written key list has a size the planner knows before it plans: small ones are
    broadcast and the frames are filtered where they are read, without a shuffle."""
    return materialise(keys, "keys")


def manifest(samples: DataFrame, prefix: str = "macro") -> DataFrame:
    """``macro_state, output_filename, traj_index, frame_index`` in the written order."""
    name = F.format_string(f"{prefix}%s_sample%d.pdb", F.col("state").cast("string"),
                           F.col("sample_no"))
    return samples.select(F.col("state").alias("macro_state"), name.alias("output_filename"),
                          F.col("traj_id").alias("traj_index"),
                          F.col("frame").alias("frame_index"))
