"""Substring dedup: MinHash banding over paragraphs, exact verification, removals by components.

Two kinds of paragraph, so that a passage is found wherever it stands:

* *lines*: the stretches between line breaks, of ``LINE_WORDS`` words or more, and the blocks of so many words that
  shorter lines make together, up to a blank or a long line (hard-wrapped paragraphs). A line's set of five-word shingles
  gives MinHash bands; lines of equal band values collide, and are linked if their exact Jaccard similarity is
  0.8 or more. Linked sets form components.
* *passages*: ``PASSAGE_WORDS`` words from an anchor on. Anchors are set by content (winnowing): a word whose
  five-word shingle has the least hash of any ``WINDOW`` in a row. So each stretch of ``RUN_WORDS`` words that texts share
  holds a passage that they share, less than ``WINDOW`` words from either end. A near copy of over 50 words, at 0.8 or more,
  has such a stretch: fewer changed words than that leave a shorter one have broken more than a ninth of its shingles.
  Passages that touch one another and have one keeper are a run. The run's first and last passage are compared with the keeper's
  words (by another hash than their identity), and moved out on both sides as far as the two texts agree; runs, with others that
  they touch, count if they come to ``RUN_WORDS`` words.

Of each component, or passage, that spans several documents the paragraphs in its least doc_id (the keeper) stay.

How it is spread over tasks: paragraphs go to a bucket of their identity once, as packed columns. A paragraph that is frequent
among those that a task gathers sends its least and greatest document there, and its rows elsewhere, so no bucket is hot;
bands likewise. Texts are read again for the documents that have something to verify; a bitmap of fixed size (FILTER bits),
which may let others through but holds back none of these, keeps most others out of that shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.llm.arrow import batched, fresh, packed, slices, split, unpacked
from lockfleet.llm.bitmap import FILTER, bitmap, is_set, place, tag_of, tagged, through
from lockfleet.llm.graph import components, skew_join
from lockfleet.llm.scratch import drop, written

SHINGLE, SIMILARITY = 5, 0.8
LINE_WORDS, PASSAGE_WORDS, WINDOW, RUN_WORDS = 25, 13, 13, 25
#: 1 - (1 - 0.8**ROWS)**BANDS = 0.998 of the pairs at the least similarity meet in a band.
ROWS, BANDS = 2, 6
#: Most different sets of a band that are compared in one go; more meet their first, and what isn't like it all others, block by block.
CROWD = 1000
#: Paragraphs that a task gathers, rows of one paragraph among them that make it frequent, tokens that a bucket is meant to hold.
GATHER, FREQUENT, BUCKET_TOKENS = 150_000, 16, 1_000_000

_MIX = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1 for i in range(1, ROWS * BANDS + 1)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the SHINGLE-word shingles that begin at each word."""
    n = max(0, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out * np.uint64(0x100000001B3)) ^ h[k : n + k]
        out = _mixed(out)
    return out


def _least(s: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` values the place of its least, the last of equals."""
    pick = lambda a, b: np.where(s[b] <= s[a], b, a)
    at, n = np.arange(len(s)), 1
    while 2 * n <= size:
        at = pick(at[: len(at) - n], at[n:])
        n *= 2
    return pick(at[: len(at) - (size - n)], at[size - n :]) if size > n else at


class Parsed:
    """Some texts as one run of words: hashes, documents, shingles, anchors of passages, and lines as (first, last + 1)."""

    def __init__(self, texts: list[bytes], passages: bool = True):
        buffer = b"\n\n".join(texts).lower()  # a blank line between texts ends blocks
        space = _SPACE[np.frombuffer(buffer, np.uint8)]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(space) else np.empty(0, np.int64)
        self.words = buffer.split()
        self.hashes = _hashes(self.words)
        sizes = np.array([len(t) for t in texts], np.int64) + 2
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.cumsum(sizes)), prepend=0))
        self.begin = np.searchsorted(self.doc, np.arange(len(texts)))  # each document's first word
        self.shingles = _shingles(self.hashes)
        self._lines(np.searchsorted(starts, np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10)), len(starts))
        if passages:
            self._anchors()

    def _lines(self, at_breaks: np.ndarray, n: int) -> None:
        edges = np.concatenate([[0], at_breaks, [n]])
        first, stop = edges[:-1], edges[1:]
        size = stop - first
        short = (size > 0) & (size < LINE_WORDS)
        run = np.flatnonzero(np.diff(short.astype(np.int8), prepend=0, append=0))
        begin, end = run[::2], run[1::2] - 1
        block = (end > begin) & (stop[end] - first[begin] >= LINE_WORDS) if len(begin) else np.empty(0, bool)
        own = size >= LINE_WORDS
        a, b = np.concatenate([first[own], first[begin[block]]]), np.concatenate([stop[own], stop[end[block]]])
        order = np.argsort(a)
        self.first, self.stop = a[order], b[order]

    def _anchors(self) -> None:
        doc, n = self.doc, len(self.doc)
        whole = WINDOW + SHINGLE - 1
        if n < whole:
            self.anchors = np.empty(0, np.int64)
            return
        mark = np.zeros(n, bool)
        mark[_least(self.shingles, WINDOW)[doc[: n - whole + 1] == doc[whole - 1 :]]] = True
        at = np.flatnonzero(mark)
        at = at[at + PASSAGE_WORDS <= n]
        self.anchors = at[doc[at] == doc[at + PASSAGE_WORDS - 1]]

    def passage_ids(self) -> np.ndarray:
        """64-bit identities of the words of each anchor's passage, in order."""
        s, at = self.shingles, self.anchors
        out = _mixed(s[at])
        for k in [*range(SHINGLE, PASSAGE_WORDS - SHINGLE, SHINGLE), PASSAGE_WORDS - SHINGLE]:
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) ^ s[at + k])
        return out

    def _per_line(self, how: np.ufunc, values: np.ndarray) -> np.ndarray:
        edges = np.stack([self.first, self.stop - SHINGLE + 1], axis=1).ravel()
        return how.reduceat(np.concatenate([values, values[-1:]]), edges)[::2]

    def line_ids(self) -> np.ndarray:
        """64-bit identities of each line's shingles."""
        return _mixed(self._per_line(np.add, _mixed(self.shingles))) if len(self.first) else np.empty(0, np.uint64)

    def bands(self) -> np.ndarray:
        """Band values (40 bits) of each line: a row for each band."""
        if not len(self.first):
            return np.empty((BANDS, 0), np.int64)
        least = [self._per_line(np.minimum, _mixed(self.shingles * m)) for m in _MIX]
        out = []
        for k in range(0, ROWS * BANDS, ROWS):
            value = least[k]
            for x in least[k + 1 : k + ROWS]:
                value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) ^ x)
            out.append((value >> np.uint64(24)).astype(np.int64))
        return np.stack(out)

    def set_of(self, line: int) -> np.ndarray:
        return np.unique((self.shingles[self.first[line] : self.stop[line] - SHINGLE + 1] >> np.uint64(32)).astype(np.uint32))


def _rows(docs: DataFrame) -> DataFrame:
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")


# ---- rows with equal keys meet in a bucket


def _blobs(keys: np.ndarray, rank: np.ndarray, columns: list[np.ndarray], buckets: int, salt: int) -> dict[int, list[np.ndarray]]:
    """Rows by bucket: keys (sorted, as differences), how (below), columns.

    how: 1 for a row of its own; of a key with over FREQUENT rows, 0 for all its rows, which go anywhere, and
    the number of its rows for those of least and greatest rank, which stand for it in the key's bucket.
    """
    order = np.lexsort((rank, keys))
    k = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    size = np.diff(begin, append=len(k))
    often = np.repeat(size > FREQUENT, size)
    many = size > FREQUENT
    ends = np.unique(np.concatenate([begin[many], (begin + size - 1)[many]]))
    place = np.concatenate([order, order[ends]])
    how = np.concatenate([np.where(often, 0, 1), np.repeat(size, size)[ends]])
    to = (_mixed(keys[place]) % np.uint64(buckets)).astype(np.int64)
    to = np.where(how == 0, (_mixed(keys[place] + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64), to)
    out = {}
    for b, at in split(to):
        at = at[np.argsort(keys[place[at]], kind="stable")]
        own = place[at]
        out[b] = [np.diff(keys[own], prepend=np.uint64(0)), how[at], *(c[own] for c in columns)]
    return out


def _keys(column: np.ndarray) -> np.ndarray:
    return np.cumsum(column.view(np.uint64), dtype=np.uint64)


def _met(keys: np.ndarray, how: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that stand for keys: the keys, their least and greatest rank, number of rows, and each row's key (-1 where ``how`` is 0)."""
    at = np.flatnonzero(how > 0)
    names, of = np.unique(keys[at], return_inverse=True)
    lo, hi, n = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min), np.zeros(len(names), np.int64)
    np.minimum.at(lo, of, rank[at])
    np.maximum.at(hi, of, rank[at])
    np.add.at(n, of, np.where(how[at] > 1, how[at], 2))  # those of a frequent key come in twos
    every = np.full(len(keys), -1, np.int64)
    every[at] = of
    return names, lo, hi, n // 2, every


def _scan(buckets: int):
    """All paragraphs: a row for each bucket of what a task gathers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, passages, lines, n, turn = [], [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc_ids, doc_tags = np.array(ids, np.int64), np.array(tags, np.int64)
            salt = int(_mixed(np.array([(turn << 32) ^ (ids[0] % 2**32) ^ tags[0]], np.uint64))[0])
            p = [np.concatenate(x) for x in zip(*passages)]
            q = [np.concatenate(x, axis=-1) for x in zip(*lines)]
            mine = _blobs(p[0], doc_ids[p[1]], p[1:], buckets, salt), _blobs(q[0], doc_ids[q[1]], [*q[1:4], *q[4]], buckets, salt)
            for b in sorted({*mine[0], *mine[1]}):
                x = mine[0].get(b, [np.empty(0, np.int64)] * 4)
                y = mine[1].get(b, [np.empty(0, np.int64)] * (5 + BANDS))
                used = np.unique(np.concatenate([x[2], y[2]]))
                x[2], y[2] = np.searchsorted(used, x[2]), np.searchsorted(used, y[2])
                y[4] = y[4] - y[3]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed(doc_ids[used], doc_tags[used], *x, *y)], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for part, texts in slices(batch):
                texts = [t or b"" for t in texts]
                got, base = Parsed(texts), len(ids)
                ids += part.column(0).to_pylist()
                tags += map(tag_of, texts)
                passages.append([got.passage_ids(), got.doc[got.anchors] + base, got.anchors - got.begin[got.doc[got.anchors]]])
                d = got.doc[got.first]
                lines.append([got.line_ids(), d + base, got.first - got.begin[d], got.stop - got.begin[d], got.bands()])
                n += len(got.anchors) + 4 * len(got.first)
                if n >= GATHER:
                    yield from flush()
                    ids, tags, passages, lines, n, turn = [], [], [], [], 0, turn + 1
        if n:
            yield from flush()

    return scan


_FOUND = "kind int, ident long, doc_id long, tag long, first int, stop int, keeper long, hi long, n long, bands binary"
PASSAGE, FREQUENT_PASSAGE, KEEPER, LINE, SET = range(5)


def _found(table: pa.Table) -> pa.Table:
    """What a bucket's rows say. PASSAGE: a place of a passage that repeats across documents; FREQUENT_PASSAGE: a place of a frequent
    one, its KEEPER being told apart; LINE: a line's place; SET: a different line's set with its documents."""
    parts = [unpacked(x) for x in table.column("packed").to_pylist()]
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    doc_ids, doc_tags = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    join = lambda k: np.concatenate([p[k] for p in parts])
    keyed = lambda k: np.concatenate([_keys(p[k]) for p in parts])
    owned = lambda k: np.concatenate([p[k] + s for p, s in zip(parts, shift)])
    out = []

    def rows(kind: int, ident: np.ndarray, doc: np.ndarray | None = None, **more: np.ndarray) -> None:
        columns = {"ident": ident.view(np.int64), **({} if doc is None else {"doc_id": doc_ids[doc], "tag": doc_tags[doc]}), **more}
        size = len(ident)
        kinds = {"first": pa.int32(), "stop": pa.int32(), "bands": pa.binary()}
        column = lambda c: pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(size, kinds.get(c, pa.int64()))
        out.append(pa.table({"kind": pa.array(np.full(size, kind), pa.int32()), **{c: column(c) for c in ("ident", "doc_id", "tag", "first", "stop", "keeper", "hi", "n", "bands")}}))

    keys, how, doc, first = keyed(2), join(3), owned(4), join(5)
    names, lo, hi, _, of = _met(keys, how, doc_ids[doc])
    at = np.flatnonzero(how == 1)
    at = at[(lo < hi)[of[at]]]
    rows(PASSAGE, keys[at], doc[at], first=first[at], keeper=lo[of[at]])
    at = np.flatnonzero(how == 0)
    rows(FREQUENT_PASSAGE, keys[at], doc[at], first=first[at])
    at = np.unique(of[how > 1])
    at = at[(lo < hi)[at]]
    rows(KEEPER, names[at], keeper=lo[at])

    keys, how, doc, first, size = keyed(6), join(7), owned(8), join(9), join(10)
    at = np.flatnonzero(how <= 1)
    rows(LINE, keys[at], doc[at], first=first[at], stop=(first + size)[at])
    names, lo, hi, n, of = _met(keys, how, doc_ids[doc])
    one = np.flatnonzero(of >= 0)
    one = one[np.unique(of[one], return_index=True)[1]]  # a row of each key, in the keys' order
    bands = np.stack([join(11 + k)[one] for k in range(BANDS)], axis=1)
    rows(SET, names, keeper=lo, hi=hi, n=n, bands=[x.tobytes() for x in np.ascontiguousarray(bands)])
    return pa.concat_tables(out)


# ---- lines: candidates by bands, verified by exact Jaccard


def _banded(buckets: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(own)
            ident, n = rows.column(0).to_numpy(), rows.num_rows
            values = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int64).reshape(n, BANDS).view(np.uint64)
            keys = _mixed(values + (np.arange(BANDS, dtype=np.uint64) << np.uint64(40))[None, :] + np.uint64(1)).T.ravel()
            line = np.tile(np.arange(n), BANDS)
            for b, (k, how, at) in _blobs(keys, ident[line], [line], buckets, int(ident[0]) % 2**64).items():
                used, local = np.unique(at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([packed(ident[used], k, how, local)], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            own.append(batch)
            if sum(x.num_rows for x in own) * BANDS >= GATHER:
                yield from flush()
                own = []
        if own and any(x.num_rows for x in own):
            yield from flush()

    return banded


def _collided(table: pa.Table) -> pa.Table:
    """``(value, ident)`` of band values that several sets have."""
    parts = [unpacked(x) for x in table.column("packed").to_pylist()]
    keys = np.concatenate([_keys(p[1]) for p in parts])
    how = np.concatenate([p[2] for p in parts])
    ident = np.concatenate([p[0][p[3]] for p in parts])
    _, lo, hi, _, of = _met(keys, how, ident)
    at = np.flatnonzero(how <= 1)
    at = at[(how[at] == 0) | (lo < hi)[of[at]]] if len(lo) else at
    return pa.table({"value": pa.array(keys[at].view(np.int64)), "ident": pa.array(ident[at])})


def collisions(sets: DataFrame, buckets: int) -> DataFrame:
    """``(value, ident)``: the different sets ``(ident, bands)`` that share a band value with another."""
    rows = sets.select("ident", "bands").mapInArrow(_banded(buckets), "bucket int, packed binary")
    return rows.groupBy("bucket").applyInArrow(_collided, "value long, ident long")


def _linked(members: list[dict]) -> tuple[list[int], list[int]]:
    """A chain through each linked group of a few sets."""
    rest = {x["ident"]: np.frombuffer(x["shingles"], np.uint32) for x in members}
    a, b = [], []
    if len(rest) < 2:
        return a, b
    ids = sorted(rest)
    sizes = np.array([len(rest[i]) for i in ids])
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, term = np.unique(np.concatenate([rest[i] for i in ids]), return_inverse=True)
    lists = owner[np.argsort(term, kind="stable")]  # the sets of each shingle, one after the other
    ends = np.cumsum(np.bincount(term))
    begins = np.concatenate([[0], ends[:-1]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    open_ = np.ones(len(ids), bool)
    for k in range(len(ids)):
        if not open_[k]:
            continue
        open_[k], queue = False, [k]
        while queue and open_.any():
            one = queue.pop()
            own = term[at[one] : at[one + 1]]
            own = own[ends[own] - begins[own] > 1]
            if not len(own):
                continue
            shared = np.bincount(np.concatenate([lists[begins[t] : ends[t]] for t in own.tolist()]), minlength=len(ids))
            near = open_ & (shared >= SIMILARITY * (sizes + sizes[one] - shared) - 1e-9)
            for j in np.flatnonzero(near).tolist():
                a.append(ids[one])
                b.append(ids[j])
                queue.append(j)
            open_ &= ~near
    return a, b


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            x, y = _linked(members)
            a += x
            b += y
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a set is like the first of its band value."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            near.append(shared >= SIMILARITY * (len(x) + len(y) - shared) - 1e-9)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3)), pa.array(near, pa.bool_())], names=["value", "ident", "first", "near"])


def blocks(near: DataFrame, crowd: int) -> DataFrame:
    """``(value, ident)`` for what ``near(value, ident, near)`` leaves open: each set that isn't like its value's first meets each
    other of the value, in blocks of about ``crowd``. Those that are like it are linked to one another already."""
    counts = near.groupBy("value").agg(F.ceil(F.count("*") / crowd).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("near")) / crowd).cast("int").alias("odd")).where("odd > 0")
    rows = skew_join(near, counts, "value", "inner")
    all_ = rows.withColumn("i", F.pmod(F.xxhash64("ident", F.lit(1)), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("odd") - 1)))
    odd = rows.where("not near").withColumn("j", F.pmod(F.xxhash64("ident", F.lit(2)), F.col("odd"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("value", F.col("i").cast("long"), F.col("j").cast("long")).alias("value")
    return all_.select(key, "ident").unionByName(odd.select(key, "ident")).distinct()


def _verified(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within groups ``(value, ident)`` of bounded size."""
    lists = groups.groupBy("value").agg(F.sort_array(F.collect_set("ident")).alias("m")).where(F.size("m") > 1).select("m").distinct()
    lists = lists.select(F.xxhash64("m").alias("value"), F.explode("m").alias("ident"))
    met = lists.join(sets, "ident").groupBy("value").agg(F.collect_list(F.struct("ident", "shingles")).alias("m"))
    return met.select("m").mapInArrow(_similar, "a long, b long")


def _links(met: DataFrame, sets: DataFrame, crowd: int) -> DataFrame:
    """``(a, b)`` between sets: of each band value's, in ``met(value, ident)``, the same components as all similar pairs."""
    counts = met.groupBy("value").count()
    crowded = written(counts.where(F.col("count") > crowd).select("value"), "crowded")
    if not crowded.take(1):
        return _verified(met, sets)
    few = _verified(met.join(crowded, "value", "left_anti"), sets)
    many = written(met.join(crowded, "value").distinct().join(sets, "ident").select("value", "ident", "shingles"), "crowds")
    first = many.groupBy("value").agg(F.min_by(F.struct(F.col("ident").alias("first"), F.col("shingles").alias("other")), "ident").alias("x")).select("value", "x.first", "x.other")
    near = skew_join(many, first, "value", "inner").select("value", "ident", "shingles", "first", "other")
    near = written(near.mapInArrow(_against, "value long, ident long, first long, near boolean"), "near")
    drop(many)
    out = few.unionByName(near.where("near and ident <> first").select(F.col("first").alias("a"), F.col("ident").alias("b")))
    return out.unionByName(_verified(blocks(near.select("value", "ident", "near"), crowd), sets))


# ---- texts that are read again


def _sets(bits):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Identity and shingle set (hashes of 32 bits) of lines whose identity's bit is set."""
        for batch in batches:
            for part, texts in slices(batch):
                got = Parsed([t or b"" for t in texts], passages=False)
                ident = got.line_ids().view(np.int64)
                at = np.flatnonzero(is_set(bits.value, ident % FILTER))
                yield pa.RecordBatch.from_arrays([pa.array(ident[at]), pa.array([got.set_of(k).tobytes() for k in at.tolist()], pa.binary())], names=["ident", "shingles"])

    return sets


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document's passages the runs, by keeper (kind 0: first and stop, first and last identity), and of a keeper's the places (1: first, and the run's)."""
    for batch in batches:
        ids, tags = (batch.column(k).to_numpy() for k in (0, 1))
        lists = batch.column(2)
        values = lists.flatten()
        first, ident, keeper = (values.field(c).to_numpy() for c in ("first", "ident", "keeper"))
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((first, keeper, owner))
        first, ident, keeper, owner = (x[order].astype(np.int64) for x in (first, ident, keeper, owner))
        new = np.concatenate([np.ones(min(1, len(first)), bool), (np.diff(owner) != 0) | (np.diff(keeper) != 0) | (np.diff(first) > PASSAGE_WORDS)])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(new))[: len(begin)] - 1
        mine = np.flatnonzero(keeper == ids[owner])
        run = begin[np.cumsum(new) - 1] if len(new) else begin
        at = np.concatenate([begin, mine])
        kind = np.repeat([0, 1], [len(begin), len(mine)])
        stop = np.concatenate([first[last] + PASSAGE_WORDS, first[run[mine]]])
        columns = [pa.array(kind, pa.int32()), pa.array(ids[owner[at]]), pa.array(tags[owner[at]]), pa.array(first[at], pa.int32()), pa.array(stop, pa.int32()), pa.array(ident[at]), pa.array(np.concatenate([ident[last], ident[mine]])), pa.array(keeper[at])]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "tag", "first", "stop", "ident", "last", "keeper"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the passages asked for: a hash of their words, and hashes of the words on the side asked for, the nearest first."""
    reach = WINDOW - 1
    for batch in batches:
        for part, texts in slices(batch):
            out: list[tuple] = []
            for doc_id, raw, tag, asked in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                if tag_of(raw or b"") != tag:
                    continue
                words = raw.lower().split()
                near = np.frombuffer(b"".join(map(xxhash.xxh32_digest, words)), np.uint32)
                for x in asked:
                    a = x["at"]
                    b = a + PASSAGE_WORDS
                    side = near[b : b + reach] if x["side"] else near[max(0, a - reach) : a][::-1]
                    out.append((x["ident"], x["side"], doc_id, tag, x["first"], x["stop"], x["keeper"], xxhash.xxh3_64_intdigest(b" ".join(words[a:b]), 1) - 2**63, side.tobytes()))
            columns = list(zip(*out)) or [()] * 9
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["ident", "side", "doc_id", "tag", "first", "stop", "keeper", "digest", "words"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the first two columns' words agree, before the other columns."""
    for batch in batches:
        n = []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            m = min(len(x), len(y)) // 4
            same = np.frombuffer(x, np.uint32)[:m] == np.frombuffer(y, np.uint32)[:m]
            n.append(m if same.all() else int(same.argmin()))
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), *batch.columns[2:]], names=["more", *batch.schema.names[2:]])


def _passages(docs: DataFrame, hits: DataFrame, keepers: bool) -> DataFrame:
    """Verified runs of passages ``(ident, doc_id, tag, first, stop, keeper, class_id)``, moved out as far as the text agrees with the keeper's.

    With ``keepers`` theirs are told too, and a run's class is the keeper's run that its first passage stands in.
    """
    lists = hits.groupBy(F.col("doc_id").alias("id"), "tag").agg(F.collect_set(F.struct("first", "ident", "keeper")).alias("asked"))
    runs = written(lists.mapInArrow(_joined, "kind int, doc_id long, tag long, first int, stop int, ident long, last long, keeper long"), "runs")
    others, places = runs.where("kind = 0 and doc_id <> keeper").drop("kind"), runs.where("kind = 1").select("ident", "doc_id", "tag", "first", F.col("stop").alias("run"))
    end = F.col("stop") - PASSAGE_WORDS
    ask = lambda side, ident, at: F.struct(F.lit(side).alias("side"), F.col(ident).alias("ident"), at.alias("at"))
    edges = others.select("doc_id", "tag", "first", "stop", "keeper", F.explode(F.array(ask(0, "ident", F.col("first")), ask(1, "last", end))).alias("x"))
    edges = edges.select("doc_id", "tag", "first", "stop", "keeper", "x.*")
    # of several places in the keeper's text the last has the most before it, and the first the most after it
    at = F.struct("first", "tag", "run")
    known = places.join(edges.select("ident").distinct(), "ident").groupBy("ident", "doc_id").agg(F.max(at).alias("left"), F.min(at).alias("right"))
    known = known.select("doc_id", "ident", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("x")) for k, c in enumerate(("left", "right"))])).alias("y"))
    known = known.select("doc_id", "y.x.tag", F.col("y.x.run").alias("first"), F.col("y.x.first").alias("stop"), F.col("doc_id").alias("keeper"), "y.side", "ident", F.col("y.x.first").alias("at"))
    asked = edges.unionByName(known).groupBy(F.col("doc_id").alias("id"), "tag").agg(F.collect_set(F.struct("side", "ident", "at", "first", "stop", "keeper")).alias("asked"))
    asked = written(asked, "asked")
    texts = through(_rows(docs), bitmap(asked.select(place("id"))))
    met = texts.join(asked, F.col("doc_id") == F.col("id")).select("doc_id", "text", "tag", "asked")
    around = written(met.mapInArrow(_around, "ident long, side int, doc_id long, tag long, first int, stop int, keeper long, digest long, words binary"), "around")
    own = around.where("doc_id = keeper").groupBy("ident", "side").agg(F.any_value(F.struct("digest", "words", "tag", "first", "stop")).alias("x"))
    own = own.select("ident", "side", F.col("x.digest").alias("kept_digest"), F.col("x.words").alias("kept_words"), F.col("x.tag").alias("kept_tag"), F.col("x.first").alias("kept_run"), F.col("x.stop").alias("kept_at"))
    own = written(own, "kept")  # so that Spark can split a frequent passage's rows at the join
    met = around.where("doc_id <> keeper").join(own, ["ident", "side"]).where("digest = kept_digest")
    met = met.select("words", "kept_words", "ident", "side", "doc_id", "tag", "first", "stop", "keeper", "kept_tag", "kept_run", "kept_at")
    met = met.mapInArrow(_agreeing, "more int, ident long, side int, doc_id long, tag long, first int, stop int, keeper long, kept_tag long, kept_run int, kept_at int")
    one = F.struct("more", "ident", "kept_tag", "kept_run", "kept_at")
    side = lambda k: F.max(F.when(F.col("side") == k, one))
    out = met.groupBy("doc_id", "tag", "first", "stop", "keeper").agg(side(0).alias("left"), side(1).alias("right")).where("left is not null and right is not null")
    class_of = lambda x: F.xxhash64("keeper", F.col(f"{x}.kept_tag"), F.col(f"{x}.kept_run"))
    out = out.select("left.ident", "doc_id", "tag", (F.col("first") - F.col("left.more")).alias("first"), (F.col("stop") + F.col("right.more")).alias("stop"), "keeper", class_of("left").alias("class_id"), "left", "right")
    if not keepers:
        return out.drop("left", "right")
    out = written(out, "others")
    reach = out.select("class_id", (F.col("left.kept_at") - F.col("left.more")).alias("least"), F.lit(None).cast("int").alias("most"))
    reach = reach.unionByName(out.select(class_of("right").alias("class_id"), F.lit(None).cast("int").alias("least"), (F.col("right.kept_at") + PASSAGE_WORDS + F.col("right.more")).alias("most")))
    reach = reach.groupBy("class_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    mine = runs.where("kind = 0 and doc_id = keeper").withColumn("class_id", F.xxhash64("doc_id", "tag", "first")).join(reach, "class_id")
    mine = mine.select("ident", "doc_id", "tag", F.least("first", "least").alias("first"), F.greatest("stop", "most").alias("stop"), "keeper", "class_id")
    return out.drop("left", "right").unionByName(mine)


def _in_runs(passages: DataFrame) -> DataFrame:
    """Numbers runs of passages that touch one another, a keeper's own and others apart, as ``mine`` and ``run``."""
    order = Window.partitionBy("doc_id", "tag", "mine").orderBy("first", F.desc("stop"), "ident")
    rows = passages.withColumn("mine", F.col("doc_id") == F.col("keeper"))
    rows = rows.withColumn("before", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begins = (F.col("before").isNull() | (F.col("first") > F.col("before"))).cast("long")
    return rows.withColumn("run", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def _runs(passages: DataFrame) -> DataFrame:
    """Passages that touch one another as one; runs of fewer than RUN_WORDS words are left out."""
    head = F.min_by(F.struct("class_id", "keeper"), F.struct("first", "ident")).alias("x")
    out = _in_runs(passages).groupBy("doc_id", "tag", "mine", "run").agg(F.min("first").alias("first"), F.max("stop").alias("stop"), head)
    return out.where(F.col("stop") - F.col("first") >= RUN_WORDS).select("doc_id", "tag", "first", "stop", "x.class_id", "x.keeper")


def classes(docs: DataFrame, crowd: int = CROWD, keepers: bool = True) -> DataFrame:
    """``(doc_id, tag, first, stop, class_id, keeper)``: the paragraphs that repeat across documents.

    ``first`` and ``stop`` are word places, ``tag`` a hash of the document's text; ``class_id`` is the
    component of linked line sets, or the keeper's run, and ``keeper`` the least doc_id. Without ``keepers`` their own
    runs aren't told. Paragraphs that repeat within one document only are not in it. Null and short texts, and rows
    with a null doc_id, have no paragraphs; rows that repeat a doc_id are one document, and rows that repeat its text
    too count once. An empty table gives no rows. ``docs`` must be a table that reads the same each time.
    """
    rows = _rows(docs)
    guess = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), guess // BUCKET_TOKENS)
    found = written(rows.mapInArrow(_scan(buckets), "bucket int, packed binary").groupBy("bucket").applyInArrow(_found, _FOUND), "paragraphs")
    of = lambda kind: found.where(F.col("kind") == kind)

    every = of(SET).select("ident", "keeper", "hi", "n", "bands")
    met = written(collisions(every, buckets), "collisions")
    asked = met.select("ident").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select(F.pmod("ident", F.lit(FILTER)))))
    sets = through(rows, bitmap(asked.join(every, "ident").select(place("keeper"))), then=_sets(bits), schema="ident long, shingles binary")
    sets = written(sets.groupBy("ident").agg(F.any_value("shingles").alias("shingles")), "sets")
    roots = components(_links(met, sets, crowd)).select(F.col("node").alias("ident"), "root")
    drop(sets)
    drop(met)
    spread = every.drop("bands").join(roots, "ident", "left").where("root is not null or keeper < hi").withColumn("class_id", F.coalesce("root", "ident"))
    spread = written(spread, "spread")
    kept = spread.groupBy("class_id").agg(F.min("keeper").alias("keeper"), F.max("hi").alias("hi")).where("keeper < hi").drop("hi")
    line = skew_join(of(LINE).select("ident", "doc_id", "tag", "first", "stop"), written(spread.select("ident", "class_id", "n").join(kept, "class_id"), "classes"), "ident", "inner", rows="n")
    line = line.select("doc_id", "tag", "first", "stop", "class_id", "keeper").distinct()

    hits = of(PASSAGE).select("ident", "doc_id", "tag", "first", "keeper")
    often = of(FREQUENT_PASSAGE).select("ident", "doc_id", "tag", "first")
    if often.take(1):
        hits = hits.unionByName(skew_join(often, of(KEEPER).select("ident", "keeper"), "ident", "inner"))
    return line.unionByName(_runs(_passages(docs, hits, keepers)))


def repeated(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row for each paragraph that repeats across documents (see :func:`classes`).

    ``doc_id, first_word, n_words, class_id, keeper_doc_id, removed``: the paragraph is removed unless it is in
    the keeper. Documents that share nothing have no row; rows that repeat count once.
    """
    own = F.col("doc_id") == F.col("keeper")
    return classes(docs, crowd).select("doc_id", F.col("first").alias("first_word"), (F.col("stop") - F.col("first")).alias("n_words"), "class_id", F.col("keeper").alias("keeper_doc_id"), (~own).alias("removed"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cutter(asked: str, has_n_chars: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k = names.index("text")
            texts, new, keep = batch.column(k).cast(pa.binary()).to_pylist(), [], []
            for raw, spans in zip(texts, batch.column(names.index(asked)).to_pylist()):
                if spans and raw:
                    words = [m.span() for m in _WORD.finditer(raw)]
                    gone = np.zeros(len(words) + 1, np.int64)
                    for x in spans:
                        gone[x["first"]] += 1
                        gone[x["stop"]] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    out, at = [], 0
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        out.append(raw[at : words[a][0]])
                        at = words[b - 1][1]
                    raw = b"".join([*out, raw[at:]])
                    keep.append(not gone.all())
                else:
                    keep.append(True)
                new.append(raw)
            columns = [c for n, c in zip(names, batch.columns) if n != asked]
            columns[k] = pa.array(new, pa.binary()).cast(pa.string())
            kept = [n for n in names if n != asked]
            if has_n_chars:
                j = kept.index("n_chars")
                size = pc.utf8_length(columns[k]).cast(pa.int64())
                columns[j] = pc.if_else(pc.equal(columns[k], batch.column(k)).fill_null(False), columns[j].cast(pa.int64()), size).cast(columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, names=kept).filter(pa.array(keep, pa.bool_()))

    return cut


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` with each repeated paragraph left in its keeper only, columns as they are.

    Words outside the removed paragraphs stay as they were, white space around them included. A document
    of which no word is left goes; ``n_chars``, if there, follows the new text. Documents that share nothing, null texts
    and rows with a null doc_id are unchanged; rows that repeat are all cut alike. An empty table stays empty. ``docs``
    must be a table that reads the same each time.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    gone = classes(docs, crowd, keepers=False).where("doc_id <> keeper").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    gone = written(gone, "gone")
    bits = bitmap(gone.select(place()))
    tag, key, spans = (fresh(docs.columns, x) for x in ("tag", "join_id", "spans"))

    gone = gone.select(F.col("doc_id").alias(key), F.col("tag").alias(tag + "_"), F.col("spans").alias(spans))
    rows = tagged(docs, bits, tag)
    met = rows.join(gone, (rows["doc_id"].cast("long") == gone[key]) & (rows[tag] == gone[tag + "_"]), "left").select(*[rows[f"`{c}`"] for c in docs.columns], spans)
    return through(docs, bits, inside=False).unionByName(met.mapInArrow(_cutter(spans, "n_chars" in docs.columns), docs.schema))
