"""Helpers for Arrow batches of documents in Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a worker takes up at once. A longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Most rows in an Arrow batch of documents; Spark's own default would hold tens of megabytes of text at a time.
BATCH_ROWS = 400


def batched(df: DataFrame) -> DataFrame:
    """``df``, for mapInArrow over texts: lowers the session's rows in a batch to BATCH_ROWS, unless they are fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with about ``limit`` bytes of text each, and the texts as bytes (null: None)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start), col.slice(start, i - start).cast(pa.binary()).to_pylist()
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start), col.slice(start).cast(pa.binary()).to_pylist()


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores if the table already has such a column (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers as compressed byte planes; small numbers that change little take little room."""
    head, body = [len(columns)], []
    for x in columns:
        x = np.ascontiguousarray(x)
        x = x.view(np.uint64) if x.dtype.itemsize == 8 else x.astype(np.uint64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head += [len(x), width]
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> list[np.ndarray]:
    """The columns of :func:`packed`, as int64."""
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * count, 8).tolist(), 8 + 16 * count, []
    for n, width in zip(head[::2], head[1::2]):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view(np.int64)[:, 0])
        at += n * width
    return out


def split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key that occurs, and the places where it does, in order."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=-1, append=-1)) if len(keys) else np.empty(0, np.int64)
    for i, j in zip(edges, edges[1:]):
        yield int(keys[order[i]]), order[i:j]
