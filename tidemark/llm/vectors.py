"""What the operators over integer vectors share: valid rows, packing for Arrow, exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this squared norm every partial sum of an inner product is a whole number that float64 holds.
EXACT = 2.0**53


def usable(vector: str) -> Column:
    """Whether a vector is there and holds finite components only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def integers(vector: str, scale: float = 256.0) -> Column:
    """Each component times `scale`, as double, rounded down: array<bigint>."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def square(ints: str) -> Column:
    return F.aggregate(ints, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of an array<bigint> column as int64; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an array<bigint> column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of int64 rows, exact; largest: a bound on the squared norms of both."""
    if largest < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def extent(rows: DataFrame, ints: str) -> tuple[int, int, float]:
    """How many rows, the most components and the largest squared norm."""
    n, dim, largest = rows.agg(F.count(F.lit(1)), F.max(F.size(ints)), F.max(square(ints))).first()
    if (largest or 0.0) >= 2.0**63:
        raise ValueError("inner products of these vectors do not fit a long")
    return n, dim or 0, largest or 0.0


def first_ranked(key: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each key, by falling score, ties by smaller ident."""
    order = np.lexsort((ident, -score, key))
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return order[rank < k]
