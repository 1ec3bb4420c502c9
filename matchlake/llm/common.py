"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.materialize import materialised  # noqa: F401


def id_bucket(col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id): the fixed split into learning and held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % parts


def slices(batch: pa.RecordBatch, column: str, max_bytes: int, max_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the binary or string ``column`` holds at most ``max_bytes`` in at most ``max_rows`` per part (a single longer row stands alone)."""
    values = batch.column(column)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type) else np.int32)
    offsets = offsets[values.offset : values.offset + len(values) + 1].astype(np.int64)
    start, n = 0, len(values)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1)
        stop = min(stop, start + max_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def byte_buffer(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column back to back, and the n + 1 offsets into them (a null has length zero)."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    bufs = values.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]
