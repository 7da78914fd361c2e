"""Moving fixed-width array columns between Arrow batches and NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T


def to_matrix(column, dtype=np.float64) -> np.ndarray:
    """A list column as an ``[n, d]`` matrix. Ragged or null rows are refused."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("null vector")
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0), dtype=dtype)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null element in a vector")
    width, rest = divmod(len(flat), rows)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if rest or (lengths != width).any():
        raise ValueError("vectors of different length")
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, width)


def to_lists(matrix: np.ndarray) -> pa.ListArray:
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int64) * width
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("batch too large; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(matrix.ravel()))


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        list(batch.columns) + list(columns.values()), names=batch.schema.names + list(columns)
    )


def widened(schema: T.StructType, names, kind: T.DataType | None = None) -> T.StructType:
    """The schema with one more column per name: a vector of doubles unless ``kind`` says otherwise."""
    kind = kind or T.ArrayType(T.DoubleType())
    return T.StructType([*schema.fields, *[T.StructField(n, kind) for n in names]])


def group_codes(columns: list[pa.Array], rows: int) -> tuple[list[tuple], np.ndarray]:
    """The distinct keys of a batch and the key number of every row, without a per-row loop."""
    code = np.zeros(rows, dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, codes = np.unique(code, return_index=True, return_inverse=True)
    keys = list(zip(*[column.take(pa.array(first)).to_pylist() for column in columns])) or [()]
    return keys, codes
