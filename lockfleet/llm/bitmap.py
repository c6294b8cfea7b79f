"""Bitmaps of fixed size that choose, where documents stand, those that are worth a shuffle.

A bitmap holds a bit for each of FILTER places that ids are hashed to. It may let others through, and the more documents there are,
the more it does; it holds back none that count. So results don't depend on it, and it may be sent to all tasks at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import appended, batched, fresh, slices

#: Bits of a bitmap (8 MB).
FILTER = 1 << 26


def tag_of(text: bytes) -> int:
    """Tells rows apart that share a doc_id but not a text."""
    return xxhash.xxh3_64_intdigest(text) >> 33


def bitmap(places: DataFrame) -> np.ndarray:
    """A bit for each value (under FILTER) of the one column of ``places``; FILTER bits at any size."""
    at = F.col(places.columns[0])
    rows = places.groupBy(F.floor(at / 32768).alias("b")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(32768))).alias("bits")).collect()
    out = np.zeros(FILTER // 8, np.uint8)
    for r in rows:
        out[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def place(doc_id: str = "doc_id"):
    """The bit of a document. That of a null id may be set for another; null ids match nothing later."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(FILTER)).alias("place")


def through(docs: DataFrame, bits: np.ndarray, inside: bool = True, then=None, schema=None) -> DataFrame:
    """The rows whose document's bit is set, or isn't; ``then`` maps their batches on in the same worker."""
    at = fresh(docs.columns, "place")
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = is_set(sent.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(here == inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(keep(batches)) if then else keep(batches)

    return docs.withColumn(at, place()).mapInArrow(run, schema or docs.schema)


def tagged(docs: DataFrame, bits: np.ndarray, name: str) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` whose document's bit is set, and their texts' tags in a column of that name."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                yield appended(part, **{name: pa.array([tag_of(x or b"") for x in texts], pa.int64())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` bigint"])
    return through(batched(docs), bits, then=tag, schema=schema)
