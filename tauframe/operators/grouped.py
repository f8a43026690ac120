"""Run a numpy step once per model on that model's coordinate rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, types as T


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def per_model(rows: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
              tail: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """``fn`` maps one model's rows to its result rows; key columns are carried along.

    A group is one model's matrix (or series of matrices): its size is set by the number of
    states and lags, not by the data, because counting has already happened.
    """
    keys = list(keys)
    schema = T.StructType([*[T.StructField(k, field_type(rows, k)) for k in keys],
                           *[T.StructField(n, t) for n, t in tail]])
    names = [n for n, _ in tail]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)[names]
        for pos, key in enumerate(keys):
            value = pdf[key].iloc[0]
            out.insert(pos, key, pd.Series([value] * len(out), index=out.index,
                                           dtype=pdf[key].dtype))
        return out

    grouped = rows.groupBy(*keys)
    return grouped.applyInPandas(run, schema)
