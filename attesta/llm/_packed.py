"""Shuffles of many small numbers as few packed rows.

A map task deals its numbers out to buckets and sends each bucket as one row
of binary columns; a reduce task joins the rows of its buckets. A shuffled
number then costs its own bytes, not those of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _store

#: Buckets for each shuffle partition; more of them even out the partitions.
BUCKETS = 8


def schema(columns: list[str]) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns)


def buckets(spark) -> int:
    return BUCKETS * _store.partitions(spark)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """One row for each bucket that occurs; the order within a bucket stays."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
    arrays: list[pa.Array] = [pa.array(b[edges[:-1]].astype(np.int32))]
    for c in columns.values():
        data = np.ascontiguousarray(c[order])
        offsets = (edges * data.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def unpack(batches: Iterator[pa.RecordBatch], types: dict[str, type]) -> dict[str, np.ndarray]:
    """All numbers of a task's buckets."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in types}
    for batch in batches:
        for c, kind in types.items():
            column = batch.column(batch.schema.get_field_index(c))
            for x in column:
                parts[c].append(np.frombuffer(x.as_buffer(), kind))
    return {c: np.concatenate(x) if x else np.zeros(0, types[c]) for c, x in parts.items()}


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(_store.partitions(df.sparkSession), "bucket")
