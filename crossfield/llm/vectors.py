"""Vectors as Spark columns and as numpy matrices, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, has components, and all are finite numbers."""
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & number


def squared_length(vector: Column, scale: int) -> Column:
    """Squared length of the scaled vector, in double precision."""
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.pow(F.lit(float(scale)) * x.cast("double"), F.lit(2.0)))


def integers(vector: Column, scale: int) -> Column:
    """Each component x as floor(scale * x), x as double; the caller has bounded the length."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).try_cast("int"))


def one_row_per_id(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Of the rows that share an id, the smallest by ``values``; rows without an id go."""
    least = F.min(F.struct(*values)).alias("least")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(least).select(key, "least.*")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix, one row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def first_of_each(group: np.ndarray, most: int) -> np.ndarray:
    """Mask of the first ``most`` entries of each run of equal values in a sorted array."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return place < most
