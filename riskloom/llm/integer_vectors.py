"""Vectors as whole numbers, so that distances and products are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 27


def finite(vector: str) -> Column:
    """True for a vector without null or non-finite components, never null."""
    known = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(known, F.lit(False))


def scaled(vector: str, factor: int, limit: int = LIMIT) -> Column:
    """floor(factor * x) of every component as array<int>. A component of
    ``limit`` or more would leave the range in which sums stay exact: an error."""
    def one(v: Column) -> Column:
        x = F.lit(float(factor)) * v.cast("double")
        return F.when(F.abs(x) < limit, F.floor(x).cast("int")).otherwise(
            F.raise_error(F.concat(F.lit("component out of range: "), v.cast("string"))).cast("int"))
    return F.transform(vector, one)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column of one length as int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
