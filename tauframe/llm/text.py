"""Shared expressions and table access of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the code points 0x20 and 0x09 to 0x0D.
SPACE = "[ \\t-\\r]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def whole(text: Column | str) -> Column:
    """The text; a null text counts as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Maximal runs of characters other than ASCII white space; none for a null text."""
    return F.filter(F.split(whole(text), f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def span(last: Column) -> Column:
    """0 .. last; empty when ``last`` is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(
        F.array().cast("array<int>"))


def settled(value: Column) -> Column:
    """``value``, tied to the task it is made in. A later filter on it is then not rewritten in terms
    of what it was made from, which would repeat nested list expressions over and over."""
    return F.when(F.spark_partition_id() >= 0, value)
