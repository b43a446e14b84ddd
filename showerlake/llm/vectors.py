"""What the two vector operators share: reading vectors and writing their digests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def width(df: DataFrame, column: str) -> int:
    """The commonest length of the vectors (of equals the smallest); 0 without any."""
    sizes = df.select(F.size(column).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("rows"))
    best = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    return best[0].n if best else 0


def lengths(column: pa.Array) -> np.ndarray:
    """Length of each vector, 0 for null."""
    n = len(column)
    return np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy().astype(np.int64)), 0) if n else np.zeros(0, np.int64)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, vectors): which rows are usable, and those rows' vectors in double precision.

    Null and empty vectors, zero ones and those holding null or non-finite
    components are not usable, nor are those of another length than `width`.
    """
    column = column.cast(pa.list_(pa.float64()))
    n = len(column)
    if not n or not width:
        return np.zeros(n, bool), np.zeros((0, width))
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    values = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, dtype=float)
    fits = np.flatnonzero(lengths(column) == width)
    rows = values[at[fits][:, None] + np.arange(width)]
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.square(rows).sum(1)
        good = np.isfinite(rows).all(1) & (square > 0) & np.isfinite(square)
    usable = np.zeros(n, bool)
    usable[fits[good]] = True
    return usable, rows[good]


def precision(df: DataFrame, column: str) -> str:
    """The number type that holds the column's components exactly: single precision where the table has no more."""
    kind = df.schema[column].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def packed(rows: np.ndarray, kind: str = "<f8") -> pa.Array:
    """Rows of numbers as a binary column."""
    raw = np.ascontiguousarray(rows, kind)
    width = raw.shape[1] * raw.itemsize if raw.ndim == 2 else 0
    at = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])


def unpacked(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    """Rows of doubles from a binary column."""
    n, size = len(column), np.dtype(kind).itemsize
    if not n:
        return np.zeros((0, 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, kind)[at[0] // size : at[-1] // size].reshape(n, -1).astype(float, copy=False)
