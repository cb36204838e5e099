"""Vectors that can take part in searches and joins, and their matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)``: one row per id, without null, empty, zero and non-finite vectors.

    Where rows share an id, the smallest of their usable vectors stands for it. Null ids are left out.
    """
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (df.where(F.col(id_col).isNotNull() & fine & F.exists(vector, lambda x: x != 0))
            .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("vector")))


def by_length(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[starts[rows][:, None] + np.arange(size)].astype(np.float64)))
    return out


def normalised(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
