"""Arrow batches as numpy arrays: the shared plumbing of the operators that run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

SLICE_BYTES = 1 << 20


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty string."""
    column = pa.concat_arrays([column]) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``size`` text bytes, or one longer text."""
    if not batch.num_rows:
        return
    _, at = utf8_column(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + size, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def append(
    rows: DataFrame,
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    added: dict[str, DataType],
    omit: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` with columns that ``compute`` derives from slices of about ``SLICE_BYTES`` text.

    Columns in ``omit`` go into ``compute`` but not into the result.
    """
    names = [c for c in rows.columns if c not in omit]
    spots = [rows.columns.index(c) for c in names]
    schema = StructType(
        [rows.schema[c] for c in names] + [StructField(n, kind) for n, kind in added.items()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                columns = [batch.column(i) for i in spots] + compute(batch)
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return rows.mapInArrow(run, schema)
