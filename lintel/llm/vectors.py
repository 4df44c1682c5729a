"""Shared pieces of the vector operators: validity, classes of equal vectors, hyperplane signs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not zero, every component present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The commonest length of the usable vectors; others take no part. 0 for an empty table."""
    row = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def planes(dims: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, bits))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column without nulls as a float64 matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def pack(signs: np.ndarray) -> np.ndarray:
    """(rows, trees, bits) booleans to (rows, trees) unsigned codes, the first bit highest."""
    weights = np.uint64(1) << np.arange(signs.shape[2] - 1, -1, -1, dtype=np.uint64)
    return (signs.astype(np.uint64) * weights).sum(axis=2)
