"""How the given tables are read as trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tauframe.operators.sequences import index_frames

ATOMS = 22   # a 64-wide vector, and two zeros, read as 22 points in space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as trajectories, events in time order, 5 states."""
    return index_frames(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"],
                        [F.col("event_type").alias("state")])


def event_microstates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``event_states`` with each state split by the size of its value: 20 states."""
    v = F.col("value")
    size = (F.when(v < 15.0, 0).when(v < 35.0, 1).when(v < 70.0, 2).otherwise(3))
    state = F.concat_ws(":", "event_type", size.cast("string"))
    return index_frames(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"],
                        [state.alias("state")])


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as trajectories, orders in date order, 3 states."""
    return index_frames(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"],
                        [F.col("o_orderstatus").alias("state")])


def event_dihedrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers per frame, in the role of a torsion-angle table."""
    return index_frames(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"],
                        [F.col("value").alias("psi"),
                         F.get_json_object("props", "$.k").cast("double").alias("phi")])


def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as trajectories, vectors in id order: ``x ARRAY<DOUBLE>`` per frame."""
    return index_frames(table(spark, sf_dir, "embeddings"), "label", ["vec_id"],
                        ["vec_id", F.col("embedding").cast("array<double>").alias("x")])


def vector_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors read as packed atom coordinates ``xyz`` (3 numbers per atom)."""
    return index_frames(table(spark, sf_dir, "embeddings"), "label", ["vec_id"],
                        ["vec_id", F.concat(F.col("embedding").cast("array<double>"),
                                            F.array(F.lit(0.0), F.lit(0.0))).alias("xyz")])
