"""Runs of repeating words, by the method of Gusfield and Stoye for tandem repeats.

A square is a text twice in a row; a run is a longest stretch with one period. All texts of a batch stand one after the
other, told apart by marks that occur once, so one suffix tree serves them all. It is kept as sorted suffixes:
a node is a stretch of them that begin alike, a suffix link goes from place i to i + 1. Sorting by doubling
names all stretches of 1, 2, 4, … words; by those names two stretches are compared, and two places extended to both
sides, in steps that grow with the logarithm only, for many places at once.

1. Lempel-Ziv blocks: each is the longest text that also begins earlier, or one new word. The leftmost occurrence of a square
   either lies with its left half about a block's first word and ends in that block, or its right half holds or begins at a
   block's first word and reaches into one block before at most. So for each block some periods (in all about three a word)
   are tried at its first word, by extension to both sides: what they give covers the leftmost occurrence of
   every square.
2. From each such square a walk along suffix links visits the squares that are its rotations, as long as they stand there;
   the places in the tree that these walks come to are the whole vocabulary of squares. The walks are taken side by
   side, and squares whose half is itself repeated are left out (a shorter period has them).
3. Below each place in the tree stand all occurrences of its square. Occurrences of one period that follow one
   another merge into runs.

Words that can be in no run that is asked for are marks too: in a run of exponent x every word occurs x times at least. That
leaves most texts without any work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import appended, batched, fresh, slices

LEAST, EXPONENT = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Sorted suffixes of an array of numbers, and names of its stretches of 2**k words."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        name = np.unique(words, return_inverse=True)[1].astype(np.int32)
        self.names = [name]  # names[k][i]: the rank of words i .. i + 2**k, shorter ones at the end
        size, top = 1, int(name.max(initial=-1)) + 1
        while top < n:
            key = name.astype(np.int64) * (top + 1)
            key[: n - size] += name[size:] + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int32)
            new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            name, size, top = new, 2 * size, int(new[order[-1]]) + 1
            self.names.append(name)
        self.names = np.stack(self.names)
        self.rank = name
        self.order = np.empty(n, np.int32)
        self.order[name] = np.arange(n, dtype=np.int32)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places ``a`` on are the same as from places ``b`` on (a < b)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            live = np.flatnonzero(b + out + size <= self.n)
            same = live[name[a[live] + out[live]] == name[b[live] + out[live]]]
            out[same] += size
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places ``a`` are the same as before places ``b`` (a < b)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            live = np.flatnonzero(a - out - size >= 0)
            same = live[name[a[live] - out[live] - size] == name[b[live] - out[live] - size]]
            out[same] += size
        return out

    def below(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of sorted suffixes that begin with the ``length`` words from ``at`` on."""
        at, length = at.astype(np.int64), length.astype(np.int64)
        k = np.frexp(length.astype(np.float64))[1] - 1  # 2**k <= length < 2**(k + 1)
        k = np.minimum(k, len(self.names) - 1)  # beyond the last names no two stretches are alike
        shift = length - (1 << k)
        head, tail = self.names[k, at], self.names[k, at + shift]

        def alike(rank: np.ndarray, own: np.ndarray) -> np.ndarray:
            there = self.order[rank].astype(np.int64)
            whole = there + length[own] <= self.n
            return whole & (self.names[k[own], there] == head[own]) & (self.names[k[own], np.where(whole, there + shift[own], 0)] == tail[own])

        edges = []
        mine = self.rank[at].astype(np.int64)
        for step in (-1, 1):
            # strides double while they lead to suffixes that begin alike, and then halve
            reach, stride = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
            own = np.arange(len(at))
            while len(own):
                to = mine[own] + step * (reach[own] + stride[own])
                inside = (to >= 0) & (to < self.n)
                ok = inside & alike(np.where(inside, to, 0), own)
                own = own[ok]
                reach[own] += stride[own]
                stride[own] *= 2
            while (stride > 1).any():
                stride = np.maximum(stride // 2, 1)
                to = mine + step * (reach + stride)
                inside = (to >= 0) & (to < self.n)
                ok = inside & alike(np.where(inside, to, 0), np.arange(len(at)))
                reach += np.where(ok, stride, 0)
                if (stride == 1).all():
                    break
            edges.append(mine + step * reach)
        return edges[0], edges[1] + 1

    def blocks(self) -> np.ndarray:
        """First places of the Lempel-Ziv blocks."""
        n, rank = self.n, self.rank.tolist()
        # the neighbours, in order, of each suffix among those that begin earlier: later ones are taken out of a list, last first
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        lower, upper = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            r = rank[i]
            a, b = left[r], right[r]
            lower[i], upper[i] = a, b
            if a >= 0:
                right[a] = b
            if b < n:
                left[b] = a
        longest = np.zeros(n, np.int64)
        for near in (np.array(lower), np.array(upper)):
            there = np.flatnonzero((near >= 0) & (near < n))
            longest[there] = np.maximum(longest[there], self.ahead(self.order[near[there]], there))
        out, at, step = [], 0, np.maximum(longest, 1).tolist()
        while at < n:
            out.append(at)
            at += step[at]
        return np.array(out, np.int64)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``first[i] .. first[i] + count[i]`` for all i, one after the other, and which i each comes from."""
    own = np.repeat(np.arange(len(count)), count)
    return np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own], own


def covering(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, period, count)``: squares from ``count`` places on, that cover the leftmost occurrence of each square."""
    starts, words = tree.blocks(), tree.names[0]
    sizes = np.diff(starts, append=tree.n)
    before = np.concatenate([[0], sizes[:-1]])
    # the right half holds or begins at the block's first word: it is compared with the word a period earlier
    period, own = _ranges(np.ones(len(starts), np.int64), np.minimum(before + sizes, starts))
    near = starts[own] - period
    some = words[near] == words[starts[own]]
    a, b, p = [near[some]], [starts[own][some]], [period[some]]
    # the left half holds it, not as its first word: it is compared with the word a period later
    period, own = _ranges(np.ones(len(starts), np.int64), sizes - 1)
    far, first = starts[own] + period, starts[own]
    some = (words[far] == words[first]) & (first > 0)
    some[some] = words[far[some] - 1] == words[first[some] - 1]
    a, b, p = np.concatenate([*a, first[some]]), np.concatenate([*b, far[some]]), np.concatenate([*p, period[some]])
    back, on = tree.behind(a, b), tree.ahead(a, b)
    found = back + on >= p
    start, p, count = (a - back)[found], p[found], (back + on - p + 1)[found]
    # a stretch of squares is there for each multiple of its shortest period: the shortest has them all
    end = start + count + 2 * p - 1
    order = np.lexsort((p, end, start))
    start, end, p, count = start[order], end[order], p[order], count[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], p[first], count[first]


def vocabulary(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(low, high, period)``: each different square's place in the tree, as a stretch of sorted suffixes."""
    start, period, count = covering(tree)
    # a walk's steps: a suffix link, and the word that makes the rotation, as long as it is there
    at, own = _ranges(start, count)
    period = period[own]
    # two squares of one period are the same if their halves are; a half has a name by the names of its two ends
    k = np.minimum(np.frexp(period.astype(np.float64))[1] - 1, len(tree.names) - 1)
    key = np.stack([period, tree.names[k, at], tree.names[k, at + period - (1 << k)]])
    order = np.lexsort(key)
    key = key[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    at, period = at[order][new], period[order][new]
    low, high = tree.below(at, 2 * period)
    return low, high, period


def runs_of(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows ``(start, length, period)`` of the runs with ``length >= max(least, exponent * period)``, in order of start and period."""
    if not len(words):
        return np.empty((0, 3), np.int64)
    tree = SuffixTree(words)
    low, high, period = vocabulary(tree)
    if not len(low):
        return np.empty((0, 3), np.int64)
    ranks, own = _ranges(low, high - low)
    at, period = tree.order[ranks].astype(np.int64), period[own]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    breaks = np.ones(len(at), bool)
    breaks[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(breaks)
    last = np.append(first[1:], len(at)) - 1
    start, period = at[first], period[first]
    length = at[last] - start + 2 * period
    found = length >= np.maximum(least, exponent * period)
    out = np.stack([start[found], length[found], period[found]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _stretches(doc: np.ndarray, word: np.ndarray, least: int, times: int) -> np.ndarray:
    """The places that may be in a run: stretches of ``least`` words or more, in which each word occurs ``times`` times or more."""
    at, group = np.arange(len(word)), doc
    while len(at):
        # how often each word occurs in its stretch
        key = group[at].astype(np.int64) * (int(word.max()) + 1) + word[at]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[back] >= times
        left = at[keep]
        # stretches anew: neighbours that are left, of one document
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1] + 1) | (doc[left[1:]] != doc[left[:-1]])
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= least if len(left) else np.zeros(0, bool)
        if keep.all() and long.all():
            return at
        at = left[long]
        group = np.zeros(len(word), np.int64)
        group[at] = stretch[long]
    return at


def runs_in(docs: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """The runs of each list of words, as :func:`runs_of` has them."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.empty((0, 3), np.int64)] * len(docs)
    word = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    del flat
    doc = np.repeat(np.arange(len(docs)), sizes)
    at = _stretches(doc, word, least, exponent)
    # after each stretch comes a mark that occurs once
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
    marks = int(word.max()) + 1 + np.arange(len(cut))
    found = runs_of(np.insert(word[at], cut, marks), least, exponent)
    places = np.insert(at, cut, -1)
    found[:, 0] = places[found[:, 0]]
    owner = doc[found[:, 0]] if len(found) else np.empty(0, np.int64)
    found[:, 0] -= (np.cumsum(sizes) - sizes)[owner]
    order = np.lexsort((found[:, 2], found[:, 0], owner))
    found, owner = found[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(docs) + 1))
    return [found[a:b] for a, b in zip(edges, edges[1:])]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without what any run repeats of its first period."""
    if len(runs):
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, runs[:, 0] + runs[:, 2], 1)
        np.add.at(keep, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(keep)[:-1] == 0)]
    return b" ".join(words)


def found(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period, by start and period) and ``collapsed`` (the text without repeats).

    Words are what stands between white space (ASCII), numbered from 0. A run is a stretch with shortest period ``period``, of
    ``exponent`` periods and ``least`` words or more, that no neighbouring word extends; runs may overlap. A word is
    repeated if any run holds it after its first period. Null and empty texts have no words, no runs and an empty
    ``collapsed``. All rows and columns stay, repeated rows too; new names get underscores where ``docs`` has them.
    """
    docs = batched(docs).withColumn("text", F.col("text").cast("string"))
    a, b = fresh(docs.columns, "runs"), fresh(docs.columns, "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch, limit=4_000_000):
                words = [(x or b"").split() for x in raw]
                every = runs_in(words, least, exponent)
                flat = np.concatenate(every)
                ends = pa.array(np.cumsum([0, *map(len, every)]).astype(np.int32))
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["start", "length", "period"])
                text = pa.array([_collapsed(w, r) for w, r in zip(words, every)], pa.binary())
                yield appended(part, **{a: pa.ListArray.from_arrays(ends, spans), b: _utf8(text)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{a}` {RUNS}, `{b}` string"
    return docs.mapInArrow(run, schema)


def _utf8(texts: pa.Array) -> pa.Array:
    try:
        return pc.cast(texts, pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with texts whose words repeat from some place on, where the id asks for it: a stated set of long periods.

    With h the crc32 of the decimal id and g = h div 10: where h is divisible by 10, each word i from a = g mod n on (n words) becomes word
    a + (i - a) mod p, p being 1 + (n - a) div (3 + g mod 8). Rows without an id keep their texts.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size("__w").cast("long")
    rows = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumn("__g", g).withColumn("__a", F.when(n > 0, F.col("__g") % n))
    p = F.expr("1 + (size(__w) - __a) div (3 + __g % 8)")
    index = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")))
    text = F.array_join(F.transform(index, lambda i: F.get(F.col("__w"), i.cast("int"))), " ")
    rows = rows.withColumn("__p", p).withColumn("text", F.when(n > 0, text).otherwise(F.col("text")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` for each row of :func:`found`.

    Of the runs that with the greatest length / period stands for all (ties: least start, then period); without runs there are four
    nulls. ``runs_sha256`` is over ``start,length,period`` and a line end for each, ``collapsed_sha256`` over the text.
    """
    rows = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
    # exact: a fraction is larger if its product with the other's denominator is
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "x.start", "x.length", "x.period", F.expr("1000 * x.length div x.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
