"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of segments. A segment holds, for some documents, each of their terms (by 64-bit hash) with the list of
its positions, in the order of the terms, and the documents' ids and lengths; terms and lists are columns of their own, so that
what only needs counts reads no positions. Segments are bounded, so no term's list is ever in one place; they are searched where they
lie, without a shuffle, by as many benchmarks as there are, and the texts are not read again.

A benchmark window is looked up from its rarest term in the whole corpus: that term's list, shifted by the term's offset, is
intersected with the shifted lists of the other terms, the next rarest first. Proximity asks for all of a query's words within a span of
words, in any order, by the same lists.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text (or one item, if that is longer). A larger one takes
several passes over the index, the hits of which are put together by document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import batched, fresh, packed, slices, unpacked
from lockfleet.llm.bitmap import bitmap, place, tag_of, tagged, through
from lockfleet.llm.scratch import written

WINDOW = 13
#: Bytes of benchmark text in a block that is sent to every task.
BLOCK_BYTES = 4_000_000
#: Words that a segment of the index is meant to hold.
SEGMENT = 1_000_000
#: Candidate places that are checked at once.
CHUNK = 2_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and other than ASCII characters. Null has none."""
    return (text or b"").translate(_FOLD).split()


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, terms)), np.uint64)


def _terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and how many each text has."""
    buffer = b" ".join(t or b"" for t in texts).translate(_FOLD)
    blank = np.frombuffer(buffer, np.uint8) == 32
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(blank) else np.empty(0, np.int64)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    return _hashes(buffer.split()), np.diff(np.searchsorted(starts, ends), prepend=0)


_INDEX = "segment long, docs binary, terms binary, positions binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
    ids, tags, flat, sizes = [], [], [], []

    def flush() -> pa.RecordBatch:
        every = np.concatenate(flat)
        names, term = np.unique(every, return_inverse=True)
        order = np.argsort(term, kind="stable")
        counts = np.bincount(term, minlength=len(names))
        steps = np.diff(order, prepend=0)
        first = np.cumsum(counts) - counts
        steps[first] = order[first]
        docs = packed(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), np.array(tags, np.int64), np.concatenate(sizes))
        row = [number, docs, packed(np.diff(names, prepend=np.uint64(0)), counts), packed(steps)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["segment", "docs", "terms", "positions"])

    for batch in batches:
        for part, texts in slices(batch):
            hashes, n = _terms(texts)
            ids += part.column(0).to_pylist()
            tags += [tag_of(t or b"") for t in texts]
            flat.append(hashes)
            sizes.append(n)
            if sum(map(len, flat)) >= SEGMENT:
                yield flush()
                ids, tags, flat, sizes, number = [], [], [], [], number + 1
    if ids:
        yield flush()


def index(docs: DataFrame) -> DataFrame:
    """The index of ``docs(doc_id, text)`` as a written table of segments. Every row's every word is in it; null texts have none."""
    rows = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_segments, _INDEX), "index")


class Block:
    """Rows of terms to look up, with the items that they belong to: a benchmark's windows, or queries."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        terms, found = {}, {}
        for item, text in items:
            ids = [terms.setdefault(w, len(terms)) for w in words((text or "").encode())]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.hashes = _hashes(list(terms))
        self.sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.rows = np.full((len(found), max([1, *map(len, found)])), -1, dtype=np.int64)
        for n, x in enumerate(found):
            self.rows[n, : len(x)] = x
        #: owners[starts[w]:starts[w + 1]] are the items of row w; null ones aren't among them
        owners = [sorted(i for i in x if i is not None) for x in found.values()]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([i for x in owners for i in x], dtype=np.int64)
        self.order = np.tile(np.arange(self.rows.shape[1]), (len(found), 1))

    def count(self, table: DataFrame) -> Block:
        """Puts each row's terms in the order of their frequency in the whole index, the rarest first."""
        sent = table.sparkSession.sparkContext.broadcast(self.hashes)

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    names, own = unpacked(raw)
                    at = _find(np.cumsum(names.view(np.uint64), dtype=np.uint64), sent.value)
                    n[at >= 0] += own[at[at >= 0]]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

        total = np.zeros(len(self.hashes) + 1, np.int64)
        total[-1] = np.iinfo(np.int64).max  # of no term, where a row is short
        for r in table.select("terms").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            total[r.term] = r.n
        self.order = np.argsort(total[self.rows], axis=1, kind="stable")
        return self


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table; -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Postings:
    """A segment's lists for the terms of a block: as one sorted array of term * size + position."""

    def __init__(self, docs: bytes, terms: bytes, positions: Callable[[], bytes], block: Block):
        self.ids, self.none, self.tags, self.n_words = unpacked(docs)
        self.begin = np.cumsum(self.n_words) - self.n_words
        names, counts = unpacked(terms)
        at = _find(np.cumsum(names.view(np.uint64), dtype=np.uint64), block.hashes)
        self.size = int(self.n_words.sum()) + 1
        self.counts = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
        self.alive = np.flatnonzero(((block.rows < 0) | (np.append(self.counts, 0)[block.rows] > 0)).all(axis=1))
        if not len(self.alive):
            return
        (steps,) = unpacked(positions())
        first = np.cumsum(counts) - counts
        total = np.cumsum(steps)
        used = np.unique(block.rows[self.alive])
        used = used[used >= 0]  # the lists of terms that no whole row needs aren't spelt out
        n = self.counts[used]
        self.first = np.zeros(len(self.counts), np.int64)
        self.first[used] = np.cumsum(n) - n
        here = np.repeat(first[at[used]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        base = total[first[at[used]]] - steps[first[at[used]]]
        self.keys = np.repeat(used, n) * self.size + total[here] - np.repeat(base, n)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1  # of empty documents at one place the last is meant, which holds it

    def _rarest(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position of its rarest term) in chunks."""
        term = block.rows[self.alive, block.order[self.alive, 0]]
        size = self.counts[term]
        for lo, hi in _chunks(size):
            w = np.repeat(np.arange(lo, hi), size[lo:hi])
            inner = np.arange(len(w)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi])
            yield self.alive[w], self.keys[self.first[term[w]] + inner] - term[w] * self.size

    def phrases(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position) of all places where a row's terms stand one after the other in one document."""
        if not len(self.alive):
            return
        for w, at in self._rarest(block):
            start = at - block.order[w, 0]
            inside = (start >= 0) & (start + block.sizes[w] < self.size)
            w, start = w[inside], start[inside]
            inside = self.doc_of(start) == self.doc_of(start + block.sizes[w] - 1)
            w, start = w[inside], start[inside]
            for k in range(1, block.rows.shape[1]):
                if not len(w):
                    break
                offset = block.order[w, k]
                term = block.rows[w, offset]
                keep = (term < 0) | (_find(self.keys, term * self.size + start + offset) >= 0)
                w, start = w[keep], start[keep]
            if len(w):
                yield w, start

    def near(self, block: Block, span: int) -> list[tuple[int, int]]:
        """(row, document) where all of a row's terms stand within ``span`` words, in any order."""
        out = set()
        if not len(self.alive):
            return []
        for w, at in self._rarest(block):
            for k in range(1, block.rows.shape[1]):  # each other term must have a place less than a span away
                term = block.rows[w, block.order[w, k]]
                next_ = np.searchsorted(self.keys, term * self.size + np.maximum(at - span + 1, 0))
                found = self.keys[np.minimum(next_, len(self.keys) - 1)]
                keep = (term < 0) | ((next_ < len(self.keys)) & (found < term * self.size + np.minimum(at + span, self.size)))
                w, at = w[keep], at[keep]
            for row, doc in np.unique(np.stack([w, self.doc_of(at)], axis=1), axis=0).tolist():
                begin, end = self.begin[doc], self.begin[doc] + self.n_words[doc]
                lists = []
                for term in np.unique(block.rows[row][block.rows[row] >= 0]).tolist():
                    own = self.keys[self.first[term] : self.first[term] + self.counts[term]] - term * self.size
                    lists.append(own[np.searchsorted(own, begin) : np.searchsorted(own, end)])
                if not all(map(len, lists)):
                    continue
                ends = np.unique(np.concatenate(lists))
                for x in lists:  # a span that ends at a term's place and holds each term's last place before it
                    last = np.searchsorted(x, ends, side="right") - 1
                    ends = ends[(last >= 0) & (ends - x[np.maximum(last, 0)] < span)]
                if len(ends):
                    out.add((row, doc))
        return sorted(out)


def _chunks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK places each."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, side="right")))
        yield lo, hi
        lo = hi


_HITS = "segment long, doc int, doc_id long, tag long, n_words long, starts array<int>, stops array<int>, items array<bigint>"


def _searcher(sent) -> Callable:
    """A mapper from segments to their documents, with the stretches hit and the items found."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                segment, docs, terms = (batch.column(c)[k].as_py() for c in range(3))
                own = Postings(docs, terms, lambda k=k, batch=batch: batch.column(3)[k].as_py(), block)
                edges, pairs = np.zeros(own.size + 1, np.int64), [np.empty((0, 2), np.int64)]
                for w, start in own.phrases(block):
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + block.sizes[w], -1)
                    n = block.starts[w + 1] - block.starts[w]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.unique(np.stack([np.repeat(own.doc_of(start), n), block.owners[np.repeat(block.starts[w], n) + inner]], axis=1), axis=0))
                hit = np.cumsum(edges) > 0
                cut = np.zeros(own.size + 1, bool)
                cut[own.begin] = True  # a stretch ends with its document
                begin = np.flatnonzero(hit & (cut | ~np.concatenate([[False], hit[:-1]])))
                end = np.flatnonzero(hit & np.concatenate([cut[1:] | ~hit[1:], [True]])) + 1
                doc = own.doc_of(begin)
                found = np.unique(np.concatenate(pairs), axis=0)
                size = len(own.ids)
                lists = lambda values, of: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(size + 1)), pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, segment)), pa.array(np.arange(size), pa.int32()), pa.array(own.ids, pa.int64(), mask=own.none.astype(bool)), pa.array(own.tags), pa.array(own.n_words),
                        lists(pa.array(begin - own.begin[doc], pa.int32()), doc), lists(pa.array(end - own.begin[doc], pa.int32()), doc), lists(pa.array(found[:, 1]), found[:, 0]),
                    ],
                    names=["segment", "doc", "doc_id", "tag", "n_words", "starts", "stops", "items"],
                )

    return search


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` of text, each read by itself."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def hits(table: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of each document of an :func:`index`: its id, tag and length, the stretches that windows of the benchmark hit (``starts``, ``stops``) and the items found.

    A document word is hit if it lies inside any occurrence of any window of ``window`` item words;
    an item of fewer words, but not none, is one window. Null texts have no words; null item ids count as hits but
    are not listed; repeated items and rows are served as they stand. Without items nothing is hit; an empty index gives no rows.
    """
    context, out, n = table.sparkSession.sparkContext, None, 0
    for n, items in enumerate(_blocks(benchmark, block_bytes), 1):
        one = table.mapInArrow(_searcher(context.broadcast(Block(items, window).count(table))), _HITS)
        out = one if out is None else out.unionByName(one)
    if n == 1:
        return out
    merged = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items")]
    return out.groupBy("segment", "doc").agg(*[F.first(c).alias(c) for c in ("doc_id", "tag", "n_words")], *merged)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for starts, stops, items in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
            covered = upto = 0
            for a, b in sorted(zip(starts, stops)):
                covered += max(0, b - max(a, upto))
                upto = max(upto, b)
            n_hit.append(covered)
            own = sorted(map(str, set(items)))
            n_items.append(len(own))
            sha.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        n = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array([h > 0 and 20 * h >= w for h, w in zip(n_hit, n)])], names=["doc_id", "tag", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    found = hits(index(docs), benchmark, window, block_bytes).select("doc_id", "tag", "n_words", "starts", "stops", "items")
    return found.mapInArrow(_digests, "doc_id long, tag long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs`` (see :func:`hits`).

    A document is contaminated if it has a hit word and a twentieth of its words or more are hit. Null texts have no words and
    aren't; repeated rows have a row each, null ids included; other columns aren't read; an empty table gives no rows.
    """
    return _judged(docs, benchmark, window, block_bytes).drop("tag")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated (see :func:`report`), all columns kept, whatever their names.

    Rows that repeat go or stay together; rows that share an id go by their own texts; rows without an id too. Null texts stay, and an
    empty table stays empty.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    gone = written(_judged(docs, benchmark, window, block_bytes).where("contaminated").select("doc_id", "tag").distinct(), "contaminated")
    if not gone.take(1):
        return docs
    bits = bitmap(gone.select(place()))
    tag, key = (fresh(docs.columns, x) for x in ("tag", "join_id"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("tag").alias(tag + "_"))
    some = tagged(docs, bits, tag)
    kept = some.join(gone, some["doc_id"].cast("long").eqNullSafe(gone[key]) & (some[tag] == gone[tag + "_"]), "left_anti").drop(tag)
    return through(docs, bits, inside=False).unionByName(kept)


def proximity(docs: DataFrame, queries: list[tuple[int, str]], span: int) -> DataFrame:
    """``(doc_id, query_id)`` of documents where all of a query's words stand within ``span`` words.

    ``queries`` is a stated list of ids and texts. Words may stand in any order; repeats in a query count once. Queries without a
    word, and null texts, match nothing; each row that matches has a row, null ids included; an empty table gives no rows.
    """
    table = index(docs)
    block = Block([(i, " ".join(dict.fromkeys(x.decode() for x in words(t.encode())))) for i, t in queries], 1 << 30)
    sent = table.sparkSession.sparkContext.broadcast(block.count(table))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, terms = (batch.column(c)[k].as_py() for c in (1, 2))
                own = Postings(docs, terms, lambda k=k, batch=batch: batch.column(3)[k].as_py(), sent.value)
                out = [(None if own.none[d] else int(own.ids[d]), int(i)) for w, d in own.near(sent.value, span) for i in sent.value.owners[sent.value.starts[w] : sent.value.starts[w + 1]]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["doc_id", "query_id"])

    return table.mapInArrow(find, "doc_id long, query_id long")
