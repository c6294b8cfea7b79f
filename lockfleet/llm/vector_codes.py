"""Vector compression by product codes, with annular norm pruning.

A vector of integers is cut into consecutive parts; each part is replaced by the index of its nearest entry in
that part's codebook. The entries of a codebook are sorted by norm. By the triangle inequality an entry
nearer than the best one so far differs from a part in norm by no more than that distance, so a
binary search over the sorted norms gives the one stretch of entries (the annulus, both ends included)
that can hold the nearest, and that stretch is compared exactly. Parts go in blocks of similar norm: a block
compares the stretch that covers the annuli of its parts by one product of matrices.

All arithmetic is on integers. Matrices are of doubles where every number that occurs stays below 2**53
(so doubles are exact), of 64-bit integers where it stays below 2**63, and of Python's integers beyond.
Only a codebook's sums and counts leave the tasks, one row a task and used entry; what reaches the driver
are the codebooks, whose size is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import fresh
from lockfleet.llm.graph import skew_join
from lockfleet.llm.scratch import drop, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components at or over this magnitude after scaling are refused: their sums could leave 64 bits.
LIMIT = 1 << 31
#: Parts of similar norm that are compared together, and entries about their own norms by which a first distance is found.
BLOCK, NEAR = 512, 16


def exact(entries: np.ndarray, largest: int) -> type:
    """The narrowest number type in which all comparisons of parts up to ``largest`` with ``entries`` are exact."""
    top = max(int(abs(entries).max(initial=0)), largest, 1)
    most = 4 * max(entries.shape[1], 1) * top * top * len(entries)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


class Ring:
    """A codebook sorted by norm, for exact nearest entries (ties: the lower index)."""

    def __init__(self, entries: np.ndarray):
        square = (entries.astype(object) ** 2).sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: square[i]), np.int64)
        self.entries, self.square = entries[self.order], square[self.order]
        self.norm = np.sqrt(self.square.astype(np.float64))
        self.compared = 0
        self._tables: dict[type, np.ndarray] = {}

    def _table(self, kind: type) -> np.ndarray:
        """A column for each entry, whose product with (part, 1) is ``count * (distance - part's own square) + index``."""
        if kind not in self._tables:
            n = len(self.order)
            e = self.entries.astype(object)
            self._tables[kind] = np.vstack([(-2 * n * e).T, (n * self.square + self.order)[None, :]]).astype(kind)
        return self._tables[kind]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each part's nearest entry, and the squared distance."""
        n = len(self.order)
        kind = exact(self.entries, int(abs(parts).max(initial=0)))
        table = self._table(kind)
        own = (parts.astype(kind) ** 2).sum(axis=1) if parts.shape[1] else np.zeros(len(parts), kind)
        norm = np.sqrt(own.astype(np.float64))
        by_norm = np.argsort(norm, kind="stable")
        index, error = np.empty(len(parts), np.int64), np.empty(len(parts), object if kind is object else np.int64)
        for at in range(0, len(parts), BLOCK):
            rows = by_norm[at : at + BLOCK]
            x = np.hstack([parts[rows].astype(kind), np.ones((len(rows), 1), kind)])
            lo, hi = np.searchsorted(self.norm, norm[rows[[0, -1]]]).tolist()
            lo, hi = max(0, min(lo - NEAR // 2, n - NEAR)), min(n, max(hi + NEAR // 2, NEAR))
            best = (x @ table[:, lo:hi]).min(axis=1)
            self.compared += (hi - lo) * len(rows)
            # the part's distance to the best entry so far; a margin takes up what square roots lose
            reach = np.sqrt(np.maximum((best // n).astype(np.float64) + own[rows].astype(np.float64), 0)) * (1 + 1e-9) + 1e-6 + norm[rows] * 1e-9
            first = int(np.searchsorted(self.norm, (norm[rows] - reach).min(), "left"))
            last = int(np.searchsorted(self.norm, (norm[rows] + reach).max(), "right"))
            for a, b in ((first, min(lo, last)), (max(hi, first), last)):
                if a < b:
                    best = np.minimum(best, (x @ table[:, a:b]).min(axis=1))
                    self.compared += (b - a) * len(rows)
            best = best if kind is object else best.astype(np.int64)
            index[rows] = best % n
            error[rows] = best // n + (own[rows] if kind is object else own[rows].astype(np.int64))
        return index, error.astype(np.int64)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of each component, a row for each vector."""
    if pc.any(pc.not_equal(pc.list_value_length(vectors), width)).as_py():
        raise ValueError(f"a vector has another length than {width}, that of the first")
    flat = np.asarray(vectors.flatten()).astype(np.float64)  # times a power of two: exact
    flat = np.floor(flat * SCALE)
    if len(flat) and abs(flat).max() >= LIMIT:
        raise ValueError(f"a component of {abs(flat).max() / SCALE} is too large to be coded")
    return flat.astype(np.int64).reshape(len(vectors), width)


def kept(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is there, and holds finite components only."""
    x = F.col("embedding")
    return vectors.where(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


@dataclass
class Codebooks:
    """Entries by part, entry and position, and the length of the vectors they were made for."""

    entries: list[np.ndarray]
    width: int

    def sha256(self) -> str:
        """Of all components in decimal, comma-joined."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for row in e.tolist() for x in row).encode()).hexdigest()


def _sums(books: Codebooks):
    """A task's counts and sums of the parts that are nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Ring(e) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            x = integers(batch.column(0), books.width)
            for p, part in enumerate(np.hsplit(x, len(rings))):
                own, _ = rings[p].nearest(part)
                order = np.argsort(own, kind="stable")
                used, first = np.unique(own[order], return_index=True)
                counts[p][used] += np.diff(np.append(first, len(own)))
                if len(used) and part.shape[1]:
                    sums[p][used] += np.add.reduceat(part[order], first, axis=0)
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            columns = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used])]
            columns += [pa.array(np.ascontiguousarray(c)) for c in sums[p][used].T]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *(f"s{i}" for i in range(sums[p].shape[1]))])

    return run


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``vectors(vec_id, embedding)`` (rows as :func:`kept` leaves them); None if there is no row.

    Each starts as the parts of the ``entries`` least vec_ids (null ids last; of equal ids the lesser vector first;
    fewer rows make fewer entries). In each round all parts go to their nearest entry, which becomes the floor
    of their mean; an entry without parts stays. Vectors of different lengths are an error.
    """
    rows = vectors.select("vec_id", "embedding")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["embedding"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    start = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width)
    books = Codebooks([np.ascontiguousarray(x) for x in np.hsplit(start, parts)], width)
    names = [f"s{i}" for i in range(width // parts)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{s} long" for s in names)])
    for _ in range(rounds):
        partial = rows.select("embedding").mapInArrow(_sums(books), schema)
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        new = [e.copy() for e in books.entries]
        for r in total.collect():  # at most parts * entries rows, whatever the input's size
            new[r["part"]][r["entry"]] = [r[s] // r["n"] for s in names]
        books = Codebooks(new, width)
    return books


def encoded(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """Rows of ``vectors`` as :func:`kept` leaves them, with ``code`` (array<int>, an index a part) and ``error`` (squared distance).

    All columns stay; names get underscores where the table has them already. Without codebooks there is no row.
    """
    code, error = fresh(vectors.columns, "code"), fresh(vectors.columns, "error")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + f", `{code}` array<int>, `{error}` long"
    at = [c.lower() for c in vectors.columns].index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = [Ring(e) for e in books.entries]
        for batch in batches:
            got = [ring.nearest(x) for ring, x in zip(rings, np.hsplit(integers(batch.column(at), books.width), len(rings)))]
            codes = np.stack([i for i, _ in got], axis=1).astype(np.int32)
            offsets = pa.array(np.arange(0, codes.size + 1, len(rings), dtype=np.int32))
            columns = [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(sum(e for _, e in got))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, code, error])

    if books is None:
        return vectors.where(F.lit(False)).withColumn(code, F.lit(None).cast("array<int>")).withColumn(error, F.lit(None).cast("long"))
    return vectors.mapInArrow(run, schema)


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", into: str = "decoded") -> DataFrame:
    """``codes`` with the vector (array<double>) that each row's ``code`` stands for (null: null); an index that no entry has is an error.

    A column ``into`` that is there already stays; the new one gets underscores.
    """
    into = fresh(codes.columns, into)
    tables = [F.array(*[F.array(*[F.lit(x / SCALE) for x in row]) for row in e.tolist()]) for e in books.entries]
    parts = [F.element_at(t, F.col(code)[p] + 1) for p, t in enumerate(tables)]
    return codes.withColumn(into, F.when(F.col(code).isNotNull(), F.concat(*parts)))


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row of ``vectors(vec_id, embedding, label)``.

    ``code`` is in hexadecimal, two digits a part. ``label_error`` is the sum of errors of rows with an equal label;
    null labels count as equal. A label may have any share of the rows: sums are made before the shuffle, and the
    labels with most rows are joined where those stand.
    Null ids are coded like others and repeated rows each have a row; an empty table has none.
    """
    # labels travel as strings, so a null one has a key of its own
    key = F.when(F.col("label").isNull(), "n").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = kept(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), key.alias("label")))
    books = fitted(rows)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    hexed = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    done = written(encoded(rows, books).select("vec_id", "label", hexed.alias("code"), "error"), "codes")
    totals = written(done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    out = skew_join(done, totals, "label", "left", "rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
