"""The letters A to Z of the upper-cased text: as a column, and of an Arrow column inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def letters(text: Column) -> Column:
    # Upper-cased once nothing but ASCII is left: what translating first gives.
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", ""))


def letters_in(column: pa.Array) -> pa.Array:
    """What ``letters`` gives, for all rows of a batch at once; bytes beyond ASCII are no letters."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ((raw | 32) - np.uint8(97)) < 26
    sizes, filled = np.zeros(len(column), np.int64), np.flatnonzero(np.diff(offsets))
    if len(filled):
        sizes[filled] = np.add.reduceat(inside, offsets[:-1][filled], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64 if large else np.int32)
    made = pa.LargeStringArray if large else pa.StringArray
    return made.from_buffers(len(column), pa.py_buffer(ends.tobytes()), pa.py_buffer((raw[inside] & np.uint8(0xDF)).tobytes()))
