"""Readers: index lists, topologies, matrices, arrays and per-trajectory files."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tauframe.session import materialise

SPARK_TEXT = r"/part-\d+-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}[^/]*\.txt[^/]*$"


def read_index_list(spark: SparkSession, path: str) -> DataFrame:
    """``(atom INT)``: whitespace-separated 1-based numbers -> distinct 0-based numbers."""
    words = F.explode(F.split(F.trim("value"), r"\s+"))
    return (spark.read.text(path).select(words.alias("w")).where(F.col("w") != "")
            .select((F.col("w").cast("int") - 1).alias("atom")).distinct())


def read_topology(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """``(serial, name, resname, resid, x, y, z)`` from fixed-width PDB atom records; ``extra`` names
    folder columns (``name=value``) to keep."""
    cut = lambda start, length: F.trim(F.substring("value", start, length))
    records = spark.read.text(path).where(cut(1, 6).isin("ATOM", "HETATM"))
    return records.select(
        *extra, cut(7, 5).cast("int").alias("serial"), cut(13, 4).alias("name"),
        cut(18, 4).alias("resname"), cut(23, 4).cast("int").alias("resid"),
        cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"),
        cut(47, 8).cast("double").alias("z"))


def file_number(path: Column) -> Column:
    """The digits of the file name as a number: the order of trajectory files. Digits of
    parent folders do not count."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")
    return F.regexp_replace(name, r"\D", "").cast("bigint")


def trajectory_number(path: Column) -> Column:
    """The number of a folder ``traj_id=..``, if the file lies in one, else that of the file name."""
    folder = F.regexp_extract(path, r"/traj_id=(\d+)/", 1)
    return F.when(folder != "", folder.cast("bigint")).otherwise(file_number(path))


def holds_many(path: Column) -> Column:
    """Whether a file is one of those that ``write_frame_text`` fills with many trajectories: text that
    Spark wrote outside of a folder ``traj_id=..``."""
    return path.rlike(SPARK_TEXT) & ~path.rlike(r"/traj_id=\d+/")


def line_trajectory(line: Column) -> Column:
    """The number that a line begins with (``12: ..``)."""
    number = F.regexp_extract(line, r"^\s*(-?\d+):", 1)
    return F.when(number == "", F.raise_error("a line does not name its trajectory").cast("bigint")).otherwise(
        number.cast("bigint"))


def _holds_frame(line: Column) -> Column:
    return (F.trim(line) != "") & ~F.ltrim(line).startswith("#")


def list_trajectories(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(traj_id, path)`` of the matching files. Only file listings are read, and the lines of files
    that hold many trajectories."""
    read = lambda form: spark.read.format(form).option("pathGlobFilter", pattern).load(path)
    files = read("binaryFile").select("path").where(~holds_many(F.col("path")))
    lines = read("text").select("value", F.col("_metadata.file_path").alias("path")).where(holds_many(F.col("path")))
    named = lines.where(_holds_frame(F.col("value"))).select(line_trajectory(F.col("value")).alias("traj_id"), "path")
    return files.select(trajectory_number(F.col("path")).alias("traj_id"), "path").unionByName(named.distinct())


def read_frame_text(spark: SparkSession, path: str, pattern: str = "*", column: str = "m") -> DataFrame:
    """``(traj_id, frame, m ARRAY<DOUBLE>)`` from whitespace text with one frame a line.

    Files are split like any text: a frame's number is its place among its trajectory's lines of the
    piece it was read with plus what the earlier pieces hold of its trajectory. Pieces are ordered by
    the part number in the file name, the name, and where they begin; a trajectory's lines follow each
    other. Blank lines and lines that begin with ``#`` are no frames. The parsed lines are written
    once, so numbers and counts are of one reading."""
    meta = F.col("_metadata")
    name = F.element_at(F.split(meta["file_path"], "/"), -1)
    lines = spark.read.option("pathGlobFilter", pattern).text(path).where(_holds_frame(F.col("value")))
    lines = lines.select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_begin"), F.coalesce(
        F.nullif(F.regexp_extract(name, r"^part-(\d+)", 1), F.lit("")).cast("bigint"), F.lit(0)).alias("_part"),
        holds_many(meta["file_path"]).alias("_many"))
    words = F.when(F.col("_many"), F.regexp_replace("value", r"^[^:]*:", "")).otherwise(F.col("value"))
    rows = materialise(lines.select(
        F.when(F.col("_many"), line_trajectory(F.col("value"))).otherwise(trajectory_number(F.col("_file"))).alias("traj_id"),
        "_file", "_begin", "_part", F.monotonically_increasing_id().alias("_line"),
        F.split(F.trim(words), r"\s+").cast("array<double>").alias(column)), "lines")
    order = Window.partitionBy("traj_id").orderBy("_part", "_file", "_begin").rowsBetween(Window.unboundedPreceding, -1)
    mixed = F.raise_error("lines of several trajectories are mixed in a file").cast("bigint")
    pieces = (rows.groupBy("traj_id", "_part", "_file", "_begin")
              .agg(F.min("_line").alias("_first"), F.max("_line").alias("_last"), F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
              .select("traj_id", "_file", "_begin", F.when(F.col("_last") - F.col("_first") >= F.col("_n"), mixed)
                      .otherwise(F.col("_first")).alias("_first"), "_before"))
    # a row per trajectory and piece, whose file names are nothing in the written table's size
    return rows.join(pieces.hint("merge"), ["traj_id", "_file", "_begin"]).select(
        "traj_id", (F.col("_line") - F.col("_first") + F.col("_before")).alias("frame"), column)


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.npy",
                column: str = "x") -> DataFrame:
    """``(traj_id, frame, x ARRAY<DOUBLE>)`` from one 2-D array file per trajectory.

    One file is one trajectory and is decoded by one task; large sets belong in Parquet."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
             .select(file_number(F.col("path")).alias("traj_id"), "content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for traj, content in zip(pdf["traj_id"], pdf["content"]):
                array = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                array = array.reshape(len(array), -1)
                for at in range(0, len(array), 20_000):
                    piece = array[at:at + 20_000]
                    yield pd.DataFrame({"traj_id": traj, "frame": np.arange(at, at + len(piece)),
                                        column: list(piece)})

    return files.mapInPandas(run, f"traj_id bigint, frame bigint, {column} array<double>")


def read_matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, m ARRAY<DOUBLE>)`` from whitespace-separated text.

    ``line`` counts the lines of a file from 0. Files are read whole: a text matrix is a model
    table (one row per lag), not a trajectory."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.posexplode(F.split(F.rtrim("value"), r"\r?\n"))
    rows = text.select("file", lines.alias("line", "_l"))
    rows = rows.where((F.trim("_l") != "") & ~F.ltrim("_l").startswith("#"))
    return rows.select("file", "line", F.split(F.trim("_l"), r"\s+").cast("array<double>")
                       .alias("m"))


def read_matrix_series(spark: SparkSession, path: str) -> DataFrame:
    """``(k, m)`` of one series file; feed to ``series.unflatten``."""
    return read_matrix_rows(spark, path).select(F.col("line").alias("k"), "m")


def ingest_series(flat: DataFrame, n_lags: int, dimension: int) -> DataFrame:
    """Validate a flattened series ``(k, m)``: column types now, lengths when it runs."""
    if not isinstance(flat, DataFrame):
        raise TypeError("a matrix series is a DataFrame")
    if dict(flat.dtypes).get("m") != "array<double>" or "k" not in flat.columns:
        raise ValueError("a flattened series has columns k and m ARRAY<DOUBLE>")
    total = flat.agg(F.count(F.lit(1)).alias("t")).scalar()
    bad_len = F.raise_error("number of matrices differs from n_lags").cast("array<double>")
    bad_dim = F.raise_error("matrix size differs from dimension").cast("array<double>")
    checked = (F.when(total != n_lags, bad_len)
               .when(F.size("m") != dimension * dimension, bad_dim).otherwise(F.col("m")))
    return flat.select("k", checked.alias("m"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Saved tables and model parameters (in place of pickled objects)."""
    return spark.read.parquet(path)
