"""What the operators on vectors share: which rows count, and their numbers as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(limit: float, embedding: str = "embedding") -> Column:
    """Whether a vector is there, is not empty, and holds finite numbers below the limit only."""
    v = F.col(embedding)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < limit))


def of_one_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows whose vector has the commonest length, the longer on ties; that length, 0 if there are no rows)."""
    n = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    d = n.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()[0] or 0
    return rows.filter(F.size(vector) == d), d


def matrix(column) -> np.ndarray:
    """A list column of an Arrow batch, its rows of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), flat.dtype)
