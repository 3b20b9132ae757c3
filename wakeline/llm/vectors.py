"""What the operators on embeddings share: which vectors count, and Arrow lists as matrices.

A vector counts if it is not null and not empty, holds neither null nor non-finite components, and has the commonest length of such
vectors in its table (of equally common lengths the largest), as lengths that differ have no inner product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True where each component is a finite number; false for null and empty vectors too."""
    every = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & every, F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The commonest length of df's vectors, 0 without any; one row reaches the driver."""
    sizes = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return sizes[0]["d"] if sizes else 0


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the least row counts; without repeated keys (only they are counted) df as it is, with no shuffle of vectors."""
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return df
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_least")).select(key, *[F.col(f"_least.{c}").alias(c) for c in rest])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose lists all have d entries, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def lists(rows: np.ndarray) -> pa.Array:
    """The reverse: rows of a matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))
