"""Fixed-width list columns as matrices, without a step per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column -> (rows, width). Lists of other lengths, and NULL inside one, are errors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError("a feature vector is NULL; drop such frames first")
    if not len(column):
        return np.zeros((0, 0))
    if pa.types.is_fixed_size_list(column.type):
        width = column.type.list_size
    else:
        sizes = np.unique(np.diff(column.offsets.to_numpy()))
        if len(sizes) > 1:
            raise ValueError(f"feature vectors have different lengths: {sizes.tolist()[:5]}")
        width = int(sizes[0])
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a feature vector holds NULL; drop such frames first")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def rows_of(matrix: np.ndarray) -> pa.Array:
    """(rows, width) -> list column."""
    ends = np.arange(len(matrix) + 1) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(matrix.reshape(-1)))
