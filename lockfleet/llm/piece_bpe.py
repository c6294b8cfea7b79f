"""Encoding and decoding with merge-type piece vocabularies (BPE models of the sentencepiece library).

A text's symbols are its characters, spaces written as ``▁`` and one put in front. An agenda holds all pairs of adjacent
symbols whose concatenation is a piece, by score (highest first) and place (leftmost first); the first pair is
merged, pairs that lost a symbol are passed over, and pairs with the new symbol are added, until the agenda
is empty. Symbols that are no piece go out as the pieces of their bytes.

A merge makes a piece, so none reaches over two adjacent characters that stand side by side in no piece. Texts are
cut between all such (by one table lookup for a whole batch's characters), and
each different section is taken through the agenda once a worker and kept. The agendas of many short sections are
rows of one matrix, and each step takes the first pair of every row; a long section has a heap of its own.
Sections that enter the cache are checked against the library, a batch at a time; :func:`differing` checks whole texts.

Read are models of the merge type with byte fallback, without a normalising table, user-defined or unused
pieces; others are refused. The model reaches the workers as one broadcast of its bytes (its size is fixed).
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import appended, batched, fresh, slices

SPACE = "▁"
#: Sections that a worker's cache holds before it starts anew; longer sections than KEEP characters aren't kept.
CACHE, KEEP = 500_000, 48
#: Classes of characters at most; with more characters in longer pieces some share one, which makes fewer cuts.
CLASSES = 4096
#: Sections whose agendas are rows of one matrix, and what stands for the rank of a pair that makes no piece.
ROWS, NONE = 4096, np.iinfo(np.int32).max
# The types of pieces in a model file, the number of its merge type, and the library's text for what is unknown.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE, UNKNOWN_TEXT = 2, " ⁇ "


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: None, 5: 4}[key & 7]
            size = varint() if size is None else size
            yield key >> 3, raw[at : at + size]
            at += size


class Model:
    """A vocabulary as its model file states it."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(raw):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        kinds = {k for _, _, k in self.pieces}
        if trainer.get(3, 1) != MERGE_TYPE or not trainer.get(35, 0) or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & kinds or BYTE not in kinds:
            raise ValueError("only models of the merge type with byte fallback are read, without user-defined or unused pieces")
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that put a space in front and else leave texts as they are, are read")
        self.end = trainer.get(42, 2)


class Pairs:
    """A hash table from pairs of symbols to the symbol that they make."""

    def __init__(self, made: dict[tuple[int, int], int]):
        self.bits = max(4, (8 * len(made)).bit_length())
        self.keys, self.values, self.longest = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 1
        keys = np.array([a << 32 | b for a, b in made], np.int64)
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), made.values()):
            steps = 1
            while self.keys[slot] != -1:
                slot, steps = (slot + 1) & ((1 << self.bits) - 1), steps + 1
            self.keys[slot], self.values[slot], self.longest = key, value, max(self.longest, steps)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair makes, -1 where nothing; -1 stands for no symbol."""
        keys = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) << 32 | b)
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slots] != -1) & (keys >= 0))
        for _ in range(self.longest - 1):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slots[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out


class Codec:
    """Encoder and decoder of one model, with its cache. ``check`` holds each new section against the library."""

    def __init__(self, raw: bytes, check: bool = True):
        model = Model(raw)
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        ranks = {s: r for r, s in enumerate(sorted({model.pieces[i][1] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: ranks[model.pieces[i][1]] for p, i in self.ids.items()}
        kinds = [kind for _, _, kind in model.pieces]
        self.byte_ids = [0] * 256
        for i, (p, _, kind) in enumerate(model.pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.end = b"%d" % model.end
        self.names = [b"%d" % i for i in range(len(kinds))]
        said = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: UNKNOWN_TEXT.encode(), NORMAL: lambda p: p.replace(SPACE, " ").encode()}
        self.said = {self.names[i]: said[kind](p) for i, (p, _, kind) in enumerate(model.pieces)}
        self.silent = {n for n, kind in zip(self.names, kinds) if kind == CONTROL}
        self.bytes = {n for n, kind in zip(self.names, kinds) if kind == BYTE}
        self.spaced = {self.names[i] for p, i in self.ids.items() if p.startswith(SPACE)}
        joined = [p for p in self.rank if len(p) > 1]
        inner = "".join(sorted(set("".join(joined)) - {SPACE}))
        self.class_of = np.zeros(0x110000, np.int16)  # 0: in no piece of several characters
        for n, c in enumerate(inner + SPACE):
            self.class_of[ord(c)] = n % (CLASSES - 1) + 1
        self.adjacent = np.zeros((CLASSES, CLASSES), bool)
        for a, b in {x for p in joined for x in zip(p, p[1:])}:
            self.adjacent[self.class_of[ord(a)], self.class_of[ord(b)]] = True
        # symbols are numbered as the pieces are; characters that are parts of pieces but none themselves come after
        symbol = self.ids | {c: len(kinds) + n for n, c in enumerate(c for c in inner + SPACE if c not in self.ids)}
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in inner + SPACE:
            self.of_char[ord(c)] = symbol[c]
        self.ranks = np.full(len(kinds) + 1, NONE, np.int32)  # the last one is that of -1
        self.ranks[list(self.ids.values())] = [self.rank[p] for p in self.ids]
        self.pairs = Pairs({(symbol[p[:i]], symbol[p[i:]]): self.ids[p] for p in joined for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol})
        self.cache: dict[str, bytes] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw) if check else None
        # a character that stands alone, to set sections apart
        self.apart = next(c for c in "\n\t\0\x01" if c not in inner)

    def merged_many(self, sections: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of each section (one after the other), and how many. All characters must be parts of pieces."""
        width = max(map(len, sections))
        n, sizes = len(sections), np.fromiter(map(len, sections), np.int64, len(sections))
        chars = np.frombuffer("".join([s.ljust(width, "\0") for s in sections]).encode("utf-32-le"), np.int32).reshape(n, width)
        symbols = np.full((n, width + 1), -1, np.int32)  # the last column stands for "no symbol"
        symbols[:, :width] = np.where(np.arange(width) < sizes[:, None], self.of_char[chars], -1)
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        makes = np.full(symbols.shape, -1, np.int32)
        makes[:, :-1] = self.pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        agenda = self.ranks[makes]
        rows = np.arange(n)
        while len(rows):
            j = agenda[rows].argmin(axis=1)  # the first of equal ranks is the leftmost
            new = makes[rows, j]
            live = new >= 0
            rows, j, new = rows[live], j[live], new[live]
            gone = after[rows, j]
            k = after[rows, gone]
            symbols[rows, j], symbols[rows, gone], agenda[rows, gone], after[rows, j] = new, -1, NONE, k
            inner = k < width
            before[rows[inner], k[inner]] = j[inner]
            h = before[rows, j]  # -1 is the last column
            k = np.minimum(k, width)
            for at, made in ((j, self.pairs(new, symbols[rows, k])), (h, self.pairs(symbols[rows, h], new))):
                makes[rows, at], agenda[rows, at] = made, self.ranks[made]
        left = symbols >= 0
        return symbols[left], left.sum(axis=1)

    def merged(self, section: str) -> list[str]:
        """The symbols that are left of a section when its agenda is empty."""
        symbols: list[str] = list(section)
        n = len(symbols)
        rank = self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # a symbol of this pair has been merged into another
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + symbols[i])) is not None:
                heapq.heappush(agenda, (r, h, size + len(symbols[h])))
        return [s for s in symbols if s]

    def _section(self, section: str) -> list[int]:
        """The ids of a section, by a heap of its own."""
        out = []
        for symbol in self.merged(section):
            i = self.ids.get(symbol)
            out += [self.byte_ids[b] for b in symbol.encode()] if i is None else [i]
        return out

    def _sections(self, new: list[str]) -> list[bytes]:
        """The decimal ids of different sections, checked against the library."""
        many, ids, names = [], {}, self.names
        for s in new:
            if 1 < len(s) <= KEEP:
                many.append(s)
            else:
                ids[s] = self._section(s)
        many.sort(key=len)
        for at in range(0, len(many), ROWS):
            own = many[at : at + ROWS]
            symbols, counts = self.merged_many(own)
            if (symbols >= len(names)).any():  # characters that are no pieces go out as bytes
                ids.update((s, self._section(s)) for s in own)
                continue
            symbols, ends = symbols.tolist(), np.cumsum(counts).tolist()
            ids.update((s, symbols[a:b]) for s, a, b in zip(own, [0, *ends], ends))
        if self.library:
            self._checked(ids)
        return [b" ".join([names[i] for i in ids[s]]) for s in new]

    def _checked(self, new: dict[str, list[int]]) -> None:
        """Raises unless the library has the same ids for all sections."""
        plain = [s for s in new if s[0] == SPACE and s[-1] != SPACE]
        found = self.library.encode([s[1:] for s in plain], num_threads=1)
        if found != [new[s] for s in plain]:
            raise AssertionError(f"the library has other ids for {[s for s, x in zip(plain, found) if x != new[s]][:5]}")
        # the others are set apart: by a character after them, and one before those that don't begin with a space
        end = self._section(self.apart)
        lead = self._section(SPACE) + end
        other = [s for s in new if s[0] != SPACE or s[-1] == SPACE]
        found = self.library.encode([(s[1:] if s[0] == SPACE else self.apart + s) + self.apart for s in other], num_threads=1)
        for s, x in zip(other, found):
            if x != [*(lead if s[0] != SPACE else ()), *new[s], *end]:
                raise AssertionError(f"the library has other ids for {s!r}")

    def sections(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The sections of all texts, one after the other, and where each text's begin and end among them."""
        texts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(texts)
        classes = self.class_of[np.frombuffer(whole.encode("utf-32-le"), np.int32)]
        starts = np.cumsum([0, *map(len, texts)])
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = ~self.adjacent[classes[:-1], classes[1:]]
        cut[starts] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:])], np.searchsorted(at, starts).tolist()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The decimal ids of each text, joined by one space, the end id last."""
        every, ends = self.sections(texts)
        new = set(every).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set(every)
        new = list(new)
        got = dict(zip(new, self._sections(new)))
        long = {s: ids for s, ids in got.items() if len(s) > KEEP}
        for s in long:
            del got[s]
        self.cache.update(got)
        get = {**self.cache, **long}.__getitem__ if long else self.cache.__getitem__
        ids = list(map(get, every))
        for a, b in zip(ends, ends[1:]):
            yield b" ".join([*ids[a:b], self.end])

    def decode(self, ids: bytes) -> bytes:
        """The text, in UTF-8, that decimal ids joined by one space stand for. An id that no piece has is an error."""
        tokens = ids.split()
        try:
            raw = b"".join(map(self.said.__getitem__, tokens))
        except KeyError as e:
            raise ValueError(f"an id that no piece has: {e.args[0]!r}") from None
        # the space that was put in front goes: it is the first sound if a piece (not a byte) makes it
        first = next((t for t in tokens if t not in self.silent), None)
        raw = raw[1:] if first in self.spaced else raw
        inside = b" " + ids.rstrip().rpartition(b" ")[0] + b" "
        if any(b" " + t + b" " in inside for t in self.silent):  # bytes before and after a control piece aren't one character
            return self._mended(tokens, first)
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return self._mended(tokens, first)

    def _mended(self, tokens: list[bytes], first: bytes) -> bytes:
        """Decodes where byte pieces in a row are no UTF-8: each byte that begins no character becomes U+FFFD."""
        out, run, lead = [], bytearray(), first in self.spaced
        for t in [*tokens, b""]:
            if t in self.bytes:
                run += self.said[t]
                continue
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _is_character(bytes(run[at : at + n]), n)), 0)
                out.append(bytes(run[at : at + size]) if size else "�".encode())
                at += size or 1
            run.clear()
            if t:
                out.append(self.said[t][1:] if lead and t == first else self.said[t])
                lead &= t != first
        return b"".join(out)


def _is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[tuple, Codec] = {}


def codec(raw: bytes, check: bool = True) -> Codec:
    """This worker's codec of a model; kept between tasks."""
    key = (hash(raw), check)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, check)
    return _codecs[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    Model(raw)  # refuses here what can't be read
    return docs.sparkSession.sparkContext.broadcast(raw)


def _texts(raw: list[bytes | None]) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in raw]


def _mapper(data, make: Callable, check: bool = True) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, check)
        for batch in batches:
            for part, raw in slices(batch):
                yield make(part, raw, own)

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``piece_ids`` (array<int>), the end id last.

    Null and empty texts have the end id alone. All rows and columns stay, repeated ones too; the new column gets underscores
    where ``docs`` has its name already. An empty table stays empty. Bytes that are no UTF-8 are read as U+FFFD.
    """
    into = fresh(docs.columns, "piece_ids")
    docs = batched(docs).withColumn("text", F.col("text").cast("string"))

    def make(part, raw, own):
        return appended(part, **{into: pa.array([list(map(int, x.split())) for x in own.encode(_texts(raw))], pa.list_(pa.int32()))})

    return docs.mapInArrow(_mapper(_model(docs, path), make), f"{_schema(docs)}, `{into}` array<int>")


def decoded(rows: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text that the array column ``ids`` stands for (null: null; empty: empty). An id that no piece has is an error.

    All rows and columns stay; ``into`` gets underscores where ``rows`` has that name already.
    """
    into = fresh(rows.columns, into)
    data, at = _model(rows, path), [c.lower() for c in rows.columns].index(ids.lower())

    def run(batches):
        own = codec(data.value)
        for batch in batches:
            text = [None if r is None else own.decode(b" ".join([b"%d" % i for i in r])).decode() for r in batch.column(at).to_pylist()]
            yield appended(batch, **{into: pa.array(text, pa.string())})

    return rows.mapInArrow(run, f"{_schema(rows)}, `{into}` string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs`` (null text: empty; null ids and repeated rows stay)."""

    def make(part, raw, own):
        got = list(own.encode(_texts(raw)))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array([x.count(b" ") + 1 for x in got], pa.int64()), pa.array(map(sha, got)), pa.array([sha(own.decode(x)) for x in got])],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mapper(_model(docs, path), make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def differing(docs: DataFrame, path: str) -> DataFrame:
    """The rows ``(doc_id, why)`` whose whole texts the library encodes or decodes otherwise; none, if all is right."""

    def make(part, raw, own):
        texts = _texts(raw)
        library = own.library.encode(texts, add_eos=True, num_threads=1)
        back = own.library.decode(library, num_threads=1) if library else []
        why = []
        for ours, want, text in zip(own.encode(texts), library, back):
            same = ours == b" ".join([b"%d" % i for i in want])
            why.append("ids" if not same else None if own.decode(ours) == text.encode() else "text")
        keep = [i for i, w in enumerate(why) if w]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([why[i] for i in keep], pa.string())], names=["doc_id", "why"])

    rows = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_mapper(_model(docs, path), make), "doc_id long, why string")
