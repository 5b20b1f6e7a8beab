"""Vectors as exact integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component times the factor stays below this, so that its floor and any shift are exact longs.
LARGEST = float(1 << 53)


def integers(vectors: DataFrame, factor: int, shift: int = 0) -> DataFrame:
    """vectors without the rows that take no part, and a column x: array<long> of floor(factor * c) + shift, c as double.

    Out go null vectors, vectors with a null or non-finite component or one of 2^53 / factor or more, and vectors of another
    length than the most frequent one (the larger among equally frequent ones).
    """
    fit = F.expr(f"embedding is not null and size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(cast(c as double)) < {LARGEST / factor!r}D)")
    usable = vectors.where(fit)
    sizes = usable.groupBy(F.size("embedding").alias("n")).count()
    dims = sizes.agg(F.max(F.struct("count", "n"))["n"]).first()[0] or 0
    return usable.where(F.size("embedding") == dims).withColumn("x", F.expr(f"transform(embedding, c -> floor({factor}D * cast(c as double)) + {shift}L)"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of longs as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
