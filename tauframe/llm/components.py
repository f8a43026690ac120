"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauframe.session import materialise


def saved(df: DataFrame, label: str) -> DataFrame:
    """A table of a few numbers per row, written in an eighth of the usual number of files."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartition(max(1, parts // 8)), label)


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (the smallest node of the component) for each node of ``links`` (``a, b``).

    Each round points every node at its smallest neighbour, follows the pointer once more, and
    rewrites the links between what is left; the number of links at least halves. Minima are
    combined before the shuffle, so a node with very many links costs no task more than others;
    tables are cut from their history by writing them.
    """
    edges = saved(links.select("a", "b").where("a <> b").distinct(), "links")
    found = None
    while not edges.isEmpty():
        low = (edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .groupBy("a").agg(F.min("b").alias("m"))
               .select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        low = saved(low, "pointers")
        above = low.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        low = saved(low.join(above, "up").select("node", F.col("upper").alias("up")), "pointers")
        if found is None:
            found = low.select("node", F.col("up").alias("comp"))
        else:
            found = found.join(low.withColumnRenamed("node", "comp"), "comp", "left").select(
                "node", F.coalesce("up", "comp").alias("comp"))
        found = saved(found, "components")
        edges = (edges.join(low.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
                 .join(low.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                 .distinct())
        edges = saved(edges, "links")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return found
