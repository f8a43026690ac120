"""Parameter grids of the sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

# The published example settings.
FEATURE_SIZES = [4, 8, 12, 16, 20, 24, 28]
PROJECTION_LAGS = [2, 4, 6]
PROJECTION_SIZES = [20, 24, 28]
CLUSTER_BASE = {"no_features": 24, "no_components": 3, "no_clusters": 800, "tica_lagtime": 2}
CLUSTER_SWEEP = {"no_features": [20, 24, 28], "no_components": [2, 3, 4],
                 "no_clusters": [700, 800, 900], "tica_lagtime": [2, 4, 6]}
TIMESCALE_LAGS = [1, *range(10, 210, 10)]


def product(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of the given short lists, first axis slowest."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def one_at_a_time(spark: SparkSession, base: Mapping[str, int] = CLUSTER_BASE,
                  axes: Mapping[str, Sequence[int]] = CLUSTER_SWEEP) -> DataFrame:
    """``(parameter, value, <base columns>, run_id)``: each axis varied with the others at the
    base. Rows with equal settings have equal ``run_id``, so a shared baseline runs once.
    Names, not positions, say which parameter a value belongs to."""
    rows = []
    for name, values in axes.items():
        for value in values:
            rows.append((name, int(value), *[int({**base, name: value}[c]) for c in base]))
    schema = "parameter string, value int, " + ", ".join(f"{c} int" for c in base)
    run_id = F.concat_ws("-", *base)
    return spark.createDataFrame(rows, schema).withColumn("run_id", run_id)
