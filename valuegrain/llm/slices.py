"""Arrow batches in slices of bounded text, so that a task holds little at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

#: Bytes of text in a slice, about; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def byte_slices(
    batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES, rows: int = 1 << 30
) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with up to ``limit`` bytes in a text or binary column, and up to ``rows`` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, before = 0, 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, before + limit, "right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a text or binary column as bytes; null counts as empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def schema_of(*fields: T.StructField, more: str) -> T.StructType:
    """The given fields, then those of a DDL text."""
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])
