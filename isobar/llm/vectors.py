"""What the two vector operators share: reading vectors, and blocks of them in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, as_it_is: bool = False) -> DataFrame:
    """Rows (id, v array<double>, dim), or v of the column's own type if as_it_is, whose vectors take part: not null, no null or non-finite component, not all zero."""
    v = F.col(vec_col).cast("array<double>")
    fine: Column = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(vec_col).isNotNull()).where(F.coalesce(fine & some, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), (F.col(vec_col) if as_it_is else v).alias("v"), F.size(vec_col).alias("dim"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
