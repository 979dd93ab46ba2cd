"""Fixed-width records packed into blobs for an exchange: a few wide rows instead of a row for each record.

A producer sorts its records by bucket and emits one row (bucket, blob) for each bucket of a batch; after
repartitioning by bucket a task holds every record of its buckets. Records are numpy structured rows, so both sides
work on whole arrays. A partition's size is the records over the number of partitions, which follows the session's
shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import cut, small_batches, trim

SCHEMA = "bucket int, blob binary"
#: Bytes of records that a task holds before it sends them.
HOLD = 8 << 20


def partitions(df: DataFrame, times: int = 2) -> int:
    small_batches(df.sparkSession)
    return times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(records: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that has records."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, int)
    ends = np.concatenate([[0], cuts, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    blobs = [records[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]].astype(np.int32) if len(bucket) else [], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def sent(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], most: int) -> DataFrame:
    """(bucket, blob) rows of the records and buckets that fn makes of slices of df; records of many slices are held
    (HOLD bytes), so rows follow the tasks and buckets, not the slices."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held, size = [], 0
        for batch in batches:
            for part in cut(batch, column, most) if batch.num_rows else ():
                held.append(fn(part))
                size += held[-1][0].nbytes
                if size >= HOLD:
                    yield dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))
        trim(False)

    return df.mapInArrow(run, SCHEMA)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket, without the bucket itself, as lists of scalars; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
            if bucket != now:
                if held:
                    yield held
                now, held = bucket, []
            held.append(tuple(row))
    if held:
        yield held


def gathered(df: DataFrame, n: int, kind: np.dtype, fn: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over all records of each bucket, one bucket after another, after dealing (bucket, blob) rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for rows in by_bucket(batches):
            yield from fn(np.concatenate([np.frombuffer(x.as_buffer(), kind) for (x,) in rows]))

    return df.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
