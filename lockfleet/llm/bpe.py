"""Byte-level BPE encoding and decoding over vectorised pre-tokenisation.

Pieces feed a cache of merged pairs that each worker keeps; a missing piece is merged by rank. The
rank file reaches the workers as one broadcast of its bytes (the vocabulary's size is fixed), so it
needs to be readable on the driver only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import appended, batched, fresh, slices
from lockfleet.llm.pretokenize import pieces

#: Pieces that a worker's cache holds before it starts anew; longer pieces than KEEP bytes aren't kept.
CACHE, KEEP = 150_000, 64
#: No pair's rank.
NONE = np.iinfo(np.int32).max


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes, from the text of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def _count(ids: bytes) -> int:
    return ids.count(b" ") + 1 if ids else 0


class Codec:
    """Encoder and decoder of one vocabulary, with its cache."""

    def __init__(self, data: bytes):
        self.ranks = ranks_of(data)
        tokens = {i: t for t, i in self.ranks.items()}
        self.sizes = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.names = [b"%d" % i for i in range(len(self.sizes))]
        self._pair_table()

    def _pair_table(self) -> None:
        """A hash table from (left id, right id) to the id of their merge, for every split of every token."""
        get, found = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    found[a << 20 | b] = rank
        keys = np.fromiter(found, np.int64, len(found))
        ids = np.fromiter(found.values(), np.int32, len(found))
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, NONE, np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):  # those that find their slot taken move on by one
            self.probes += 1
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.merged[slot[first]] = keys[first], ids[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids, slot = keys[rest], ids[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids that adjacent tokens merge to; NONE where they don't, or where either is -1."""
        keys = a.astype(np.int64) << 20 | b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.merged[slot], NONE)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.merged[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out

    def merge_many(self, raw: list[bytes]) -> list[bytes]:
        """Decimal ids, joined by spaces, of many pieces: in each round every piece merges its leftmost pair of least rank."""
        out: list[bytes] = [b""] * len(raw)
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        for at in range(0, len(order), 2048):
            own = order[at : at + 2048]
            width = len(raw[own[-1]])
            sizes = np.array([len(raw[i]) for i in own])
            flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
            ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[flat], -1)
            ids = np.hstack([ids, np.full((len(own), 1), -1, np.int32)])  # the last column stands for "no token"
            after = np.tile(np.arange(1, width + 2), (len(own), 1))
            before = np.tile(np.arange(-1, width), (len(own), 1))  # column -1 is the last column
            rank = np.full(ids.shape, NONE, np.int32)
            rank[:, :-1] = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(own), width)
            rows = np.arange(len(own))
            while len(rows):
                j = rank[rows].argmin(axis=1)
                new = rank[rows, j]
                live = new != NONE
                rows, j, new = rows[live], j[live], new[live]
                gone = after[rows, j]
                nxt = after[rows, gone]
                ids[rows, j], ids[rows, gone], rank[rows, gone] = new, -1, NONE
                after[rows, j] = nxt
                inner = nxt < width
                before[rows[inner], nxt[inner]] = j[inner]
                nxt = np.minimum(nxt, width)
                rank[rows, j] = self._pairs(new, ids[rows, nxt])
                prev = before[rows, j]
                got = self._pairs(ids[rows, prev], new)
                inner = prev >= 0
                rank[rows[inner], prev[inner]] = got[inner]
            names = self.names
            for i, row in zip(own, ids.tolist()):
                out[i] = b" ".join([names[x] for x in row if x >= 0])
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Token ids of a piece: the pair of lowest rank is merged, leftmost first, until none is left."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        if len(raw) > KEEP:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        get = ranks.get
        pairs = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 30:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for long pieces."""
        get, n = self.ranks.get, len(raw)
        end = list(range(1, n + 1))  # part i is raw[i:end[i]] while alive
        before, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The decimal ids of each text, joined by one space."""
        cut = [own for own, _ in pieces(texts)]
        new = set().union(*cut).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*cut)
        new = list(new)
        raw = [x.encode() for x in new]
        short = [i for i, x in enumerate(raw) if len(x) <= KEEP]
        self.cache.update(zip((new[i] for i in short), self.merge_many([raw[i] for i in short])))
        long = {new[i]: b" ".join(b"%d" % t for t in self.merge(x)) for i, x in enumerate(raw) if len(x) > KEEP}
        get = {**self.cache, **long}.__getitem__ if long else self.cache.__getitem__
        for own in cut:
            yield b" ".join(map(get, own))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each row of decimal ids, joined by one space, stands for."""
        counts = [_count(x) for x in ids]
        whole, sizes = self.decode_ids(np.fromstring(b" ".join(filter(None, ids)), np.int64, sep=" "))
        ends = np.cumsum(np.concatenate([[0], sizes]))[np.cumsum([0, *counts])].tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]

    def decode_ids(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of token ids in a row, and each token's size. Ids that no token has are an error."""
        if len(ids) and (ids.min() < 0 or not self.sizes[ids].all()):
            raise ValueError("an id that no token has")
        sizes = self.sizes[ids]
        at = np.repeat(self.first[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.flat[at].tobytes(), sizes

    def offsets(self, ids: bytes) -> list[int]:
        """The first byte of each token in its text."""
        sizes = self.sizes[np.fromstring(ids, np.int64, sep=" ")]
        return (np.cumsum(sizes) - sizes).tolist()


_codecs: dict[int, Codec] = {}


def codec(data: bytes) -> Codec:
    """This worker's codec of a rank file; kept between tasks."""
    key = hash(data)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data)
    return _codecs[key]


def _ranks(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _texts(raw: list[bytes | None]) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in raw]


def _mapper(data, make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value)
        for batch in batches:
            for part, raw in slices(batch, limit=1_000_000):
                yield make(part, raw, own)

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) and ``token_offsets`` (array<int>, first byte of each token).

    Null texts are empty and have no tokens. Names get underscores where ``docs`` has them already;
    all rows and columns stay.
    """
    a, b = fresh(docs.columns, "token_ids"), fresh(docs.columns, "token_offsets")
    docs = batched(docs).withColumn("text", F.col("text").cast("string"))

    def make(part, raw, own):
        got = list(own.encode(_texts(raw)))
        ids = pa.array([[int(i) for i in x.split()] for x in got], pa.list_(pa.int32()))
        return appended(part, **{a: ids, b: pa.array([own.offsets(x) for x in got], pa.list_(pa.int32()))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{a}` array<int>, `{b}` array<int>"
    return docs.mapInArrow(_mapper(_ranks(docs, path), make), schema)


def decoded(tokens: DataFrame, path: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the text that the array column ``ids`` stands for (null: null). Unknown ids are an error.

    ``into`` gets underscores where ``tokens`` has such a column already; all rows and columns stay.
    """
    into = fresh(tokens.columns, into)
    data = _ranks(tokens, path)

    def run(batches):
        own = codec(data.value)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            text = [None if r is None else own.decode_ids(np.array(r, np.int64))[0].decode("utf-8", "replace") for r in rows]
            yield appended(batch, **{into: pa.array(text, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + f", `{into}` string"
    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs`` (null text: empty)."""

    def make(part, raw, own):
        got = list(own.encode(_texts(raw)))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_count, got), pa.int64()), pa.array(map(sha, got)), pa.array(map(sha, own.decode(got)))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mapper(_ranks(docs, path), make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``n_tokens`` for each row of ``docs``, and nothing else (null text: 0)."""

    def make(part, raw, own):
        return pa.RecordBatch.from_arrays([pa.array(map(_count, own.encode(_texts(raw))), pa.int64())], names=["n_tokens"])

    return batched(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(_mapper(_ranks(docs, path), make), "n_tokens long")
