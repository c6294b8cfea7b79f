"""Language-model scoring with a probabilistic suffix tree.

The tree has no bound but its depth: every context of up to ``DEPTH`` words is counted over the whole
corpus, every continuation seen ``LEAST`` times or more is kept, and the retention test alone decides
which contexts stay. A context stays if its next-symbol counts diverge from its parent's distribution by more
bits than their description costs. Distributions are smoothed by the parent: what a context's kept
continuations leave, plus ``MASS``, is spread as the parent spreads it. Each position is scored by the
longest suffix of its context that is a state.

How it is spread over tasks:

* Positions are shuffled by the word before them, so a *branch* of the tree (contexts that end in one word) is counted,
  tested and used in one place, for as many words as make ``BRANCH_TOKENS``. A *hot* context, with half as many
  positions, is split by the word before it, and so on down the depth; positions whose contexts are all hot go anywhere.
* What a branch can't count by itself is asked for: corpus counts of words, and counts of continuations of hot contexts.
  Each such (context, word) goes to a bucket of its word, and its total goes back to the branches that asked.
* The words that a sample finds commonest (at most ``VOCABULARY``) have small ids, and their counts are sent to all
  tasks; of the others the commonest of each bucket (as many in all) join them once all are counted.
  The sample only chooses ids and what is hot: it changes no result. All words' counts are exact.
* Scores come back to the group of documents that was read together, and are added up there.

Between tasks all this goes as packed columns, one row for each group of documents and branch.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import batched, packed, slices, split, unpacked
from lockfleet.llm.scratch import drop, written

#: Pseudo-count that a context gives to its parent's distribution.
MASS = 4.0
#: The end of a text; no word holds white space.
END = b"\n"
#: Longest context, in words, and the least count of a continuation; the retention test alone decides on contexts.
DEPTH, LEAST = 3, 2
#: Tokens that a task gathers before it passes positions on, that a branch is meant to hold, and that are sampled.
GATHER_TOKENS, BRANCH_TOKENS, SAMPLE_TOKENS = 1_500_000, 1_200_000, 4_000_000
#: Positions that are dealt with in one go.
STRETCH = 300_000
#: Most words with small ids, whose counts are sent to all tasks.
VOCABULARY = 1 << 18
#: What a bit of a description costs, in the retention test.
COST = 0.5


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text (null: empty) leaves 0 mod 10."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; never 0, which stands for no word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64) | np.uint64(1)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ y
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table; -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _shifted(x: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The value k places before, in the same document; else 0."""
    out = np.zeros_like(x)
    out[k:] = x[: len(x) - k]
    out[place < k] = 0
    return out


@dataclass
class Layout:
    """What all tasks must agree on: ids of common words, hot contexts, and how positions are dealt to branches."""

    branches: int
    depth: int
    words: np.ndarray  # hashes of the vocabulary, the commonest first
    #: for each level the sorted hashes of its hot contexts, and the numbers (over all levels, from 1) of the contexts one word shorter
    hot: list[np.ndarray] = field(default_factory=list)
    up: list[np.ndarray] = field(default_factory=list)
    sorted_words: np.ndarray | None = None
    sorted_ids: np.ndarray | None = None

    def __post_init__(self) -> None:
        order = np.argsort(self.words)
        self.sorted_words, self.sorted_ids = self.words[order], (order + 1).astype(np.int32)

    def __getstate__(self):
        return self.branches, self.depth, self.words, self.hot, self.up

    def __setstate__(self, state) -> None:
        self.branches, self.depth, self.words, self.hot, self.up = state
        self.__post_init__()

    def ids(self, names: np.ndarray) -> np.ndarray:
        """1 and more for words of the vocabulary, 0 for others."""
        at = _find(self.sorted_words, names)
        return np.where(at >= 0, self.sorted_ids[at] if len(self.sorted_ids) else 0, 0)

    @property
    def starts(self) -> list[int]:
        """The first number of each level's hot contexts; the root is 0."""
        return [0, *np.cumsum([1, *map(len, self.hot)]).tolist()]

    def paths(self, back: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per level: positions whose shorter contexts are all hot, the last of these's numbers, the contexts' hashes, and their
        own numbers if they are hot (else 0)."""
        at, number = np.arange(len(back[0])), np.zeros(len(back[0]), np.int64)
        for level in range(1, self.depth + 1):
            word = back[level][at]
            context = word if level == 1 else np.where(word > 0, _mix(context, word), np.uint64(0))
            found = _find(self.hot[level - 1], context) if level <= len(self.hot) else np.full(len(at), -1, np.int64)
            own = np.where((context > 0) & (found >= 0), found + self.starts[level], 0)
            yield at, number, context, own
            stay = own > 0
            at, context, number = at[stay], context[stay], own[stay]
            if not len(at):
                return

    def route(self, group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each position's branch; positions in hot contexts, once for each, and these contexts' numbers."""
        branch, hot, numbers = np.empty(len(group.flat), np.int32), [], []
        for i in range(0, len(group.flat), STRETCH):
            key = group.salt(i, i + STRETCH)
            for at, _, context, own in self.paths(group.back(self.depth, i, i + STRETCH)):
                cold = (own == 0) & (context > 0)
                key[at[cold]] = context[cold]
                hot.append(at[own > 0] + i)
                numbers.append(own[own > 0])
            branch[i : i + len(key)] = _mix(key, np.uint64(7)) % np.uint64(self.branches)
        return branch, *(np.concatenate([np.empty(0, np.int64), *x]) for x in (hot, numbers))


@dataclass
class Group:
    """Documents that are read together, as one run of tokens."""

    ids: list
    held: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray  # hashes of tokens

    def __post_init__(self) -> None:
        self.of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = np.arange(len(self.flat), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        self.learn = ~self.held[self.of]
        self.names, word = np.unique(self.flat, return_inverse=True)
        self.word = word.astype(np.int32)

    def back(self, depth: int, start: int = 0, stop: int | None = None) -> list[np.ndarray]:
        """The words of a stretch of positions, and those 1, 2, … places before."""
        stop = len(self.flat) if stop is None else min(stop, len(self.flat))
        lead = min(start, depth)
        own, place = self.flat[start - lead : stop], self.place[start - lead : stop]
        return [_shifted(own, place, k)[lead:] for k in range(depth + 1)]

    def salt(self, start: int, stop: int) -> np.ndarray:
        """Differs from row to row and place to place, and is the same each time."""
        own = np.array([0 if i is None else i for i in self.ids], np.int64).view(np.uint64)
        return _mix(own[self.of[start:stop]], self.place[start:stop].astype(np.uint64))


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Group]:
    ids, held, own, total = [], [], [], 0
    for batch in batches:
        for piece, texts in slices(batch):
            for doc_id, text in zip(piece.column(0).to_pylist(), texts):
                ids.append(doc_id)
                held.append(held_out(doc_id))
                own.append(_hashed(tokens(text)))
                total += len(own[-1])
                if total >= size:
                    yield Group(ids, np.array(held), np.array([len(x) for x in own]), np.concatenate(own))
                    ids, held, own, total = [], [], [], 0
    if ids:
        yield Group(ids, np.array(held), np.array([len(x) for x in own]), np.concatenate(own))


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


# ---- what is common: the vocabulary and the hot contexts, from a sample


def _sampled_contexts(hot: list[np.ndarray]):
    """How often each word occurs (while no level is known), or each context one level below the hot ones, with its parent's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = len(hot) + 1
        for group in _groups(batches, GATHER_TOKENS):
            if depth == 1:
                keys, n = group.names, np.bincount(group.word, minlength=len(group.names))
                up = np.zeros(len(keys), np.int64)
            else:
                layout, contexts, numbers = Layout(1, depth, np.empty(0, np.uint64), hot), [], []
                for i in range(0, len(group.flat), STRETCH):
                    levels = list(layout.paths(group.back(depth, i, i + STRETCH)))
                    if len(levels) == depth:
                        contexts.append(levels[-1][2])
                        numbers.append(levels[-1][1])
                if not contexts:
                    continue
                keys, first, n = np.unique(np.concatenate(contexts), return_index=True, return_counts=True)
                up, n = np.concatenate(numbers)[first], np.where(keys > 0, n, 0)
            yield _rows({"key": (keys.view(np.int64), pa.int64()), "up": (up, pa.int64()), "n": (n, pa.int64())})

    return count


def _layout(rows: DataFrame, depth: int, branch_tokens: int) -> Layout:
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    guess = size // 6 + n
    every = max(1, guess // SAMPLE_TOKENS)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)

    def sampled() -> DataFrame:
        counts = some.mapInArrow(_sampled_contexts(hot), "key long, up long, n long").groupBy("key").agg(F.any_value("up").alias("up"), F.sum("n").alias("n"))
        return written(counts, "sampled")

    hot: list[np.ndarray] = []
    up: list[np.ndarray] = []
    seen = sampled()
    common = seen.where("n > 1").orderBy(F.desc("n"), "key").limit(VOCABULARY).select("key").toArrow()
    end = int(_hashed([END]).view(np.int64)[0])
    while True:
        found = sorted((r.key % 2**64, r.up) for r in seen.where(F.col("n") * every * 2 > branch_tokens).select("key", "up").collect() if r.key != end)
        drop(seen)
        if not found:
            break
        hot.append(np.array([k for k, _ in found], np.uint64))
        up.append(np.array([u for _, u in found], np.int64))
        if len(hot) == depth:
            break
        seen = sampled()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Layout(max(least, guess // branch_tokens), depth, common.column("key").to_numpy().view(np.uint64).copy(), hot, up)


# ---- what branches ask for


def _asked(layout: Layout, buckets: int):
    """Rows (bucket, packed): counts of common words; (context, word, branch, count) of other words and of hot contexts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, GATHER_TOKENS):
            m = len(group.names)
            ids = layout.ids(group.names)
            branch, hot, numbers = layout.route(group)
            rare = np.flatnonzero(ids[group.word] == 0)
            at, context = np.concatenate([rare, hot]), np.concatenate([np.zeros(len(rare), np.int64), numbers])
            key, entry = np.unique((context * layout.branches + branch[at]) * m + group.word[at], return_inverse=True)
            n = np.bincount(entry, group.learn[at], minlength=len(key)).astype(np.int64)
            word, key = key % m, key // m
            common = np.flatnonzero(ids > 0)
            counts = np.bincount(group.word, group.learn, minlength=m).astype(np.int64)[common]
            place = (_mix(group.names, np.uint64(3)) % np.uint64(buckets)).astype(np.int64)
            mine, of_bucket = dict(split(place[word])), {}
            for b, x in split(place[common]):
                order = x[np.argsort(ids[common[x]])]
                of_bucket[b] = [np.diff(ids[common[order]], prepend=0), counts[order]]
            for b in sorted({*mine, *of_bucket}):
                x = mine.get(b, np.empty(0, np.int64))
                x = x[np.lexsort((key[x], word[x]))]
                names, local = np.unique(word[x], return_inverse=True)
                blob = packed(np.diff(group.names[names], prepend=np.uint64(0)), np.diff(local, prepend=0), key[x] // layout.branches, key[x] % layout.branches, n[x], *of_bucket.get(b, [np.empty(0, np.int64)] * 2))
                yield _rows({"bucket": ([b], pa.int32()), "packed": ([blob], pa.binary())})

    return ask


_TOTALS = "kind int, branch int, packed binary, total long, kinds long"


def _totals(layout: Layout):
    """A bucket's totals. Kind 0: for each branch (word, context, total); 1: counts of common words, and of the commonest others;
    2: of hot contexts, for the retention test."""
    most = -(-VOCABULARY // layout.branches)

    def add(table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("packed").to_pylist()]
        names = [np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts]
        every = np.unique(np.concatenate(names))
        word = np.concatenate([np.searchsorted(every, x)[np.cumsum(p[1])] for x, p in zip(names, parts)])
        context, branch, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        ids, counts = np.concatenate([np.cumsum(p[5]) for p in parts]), np.concatenate([p[6] for p in parts])
        ids, of = np.unique(ids, return_inverse=True)
        counts = np.bincount(of, counts, minlength=len(ids)).astype(np.int64)
        m, out = len(every), {"kind": [], "branch": [], "packed": [], "total": [], "kinds": []}

        def row(kind: int, b: int | None, blob: bytes, total: int = 0, kinds: int = 0) -> None:
            for k, v in zip(out, (kind, b, blob, total, kinds)):
                out[k].append(v)

        key, of = np.unique(context * m + word, return_inverse=True)
        k = np.bincount(of, n, minlength=len(key)).astype(np.int64)
        c = np.zeros(m, np.int64)  # counts by word, of whichever kind
        rare = key < m
        c[key[rare]] = k[rare]
        top = np.flatnonzero(c > 1)
        top = np.sort(top[np.argsort(-c[top], kind="stable")[:most]])
        row(1, None, packed(np.diff(ids, prepend=0), counts, np.diff(every[top], prepend=np.uint64(0)), c[top]), int(counts.sum() + c.sum()), int((counts > 0).sum() + (c > 0).sum()))
        own = layout.ids(every)
        c[own > 0] = counts[_find(ids, own[own > 0])]
        if (~rare).any():
            at = np.flatnonzero(~rare)
            w, level = key[at] % m, np.searchsorted(layout.starts, key[at] // m, "right") - 1
            row(2, None, packed(key[at] // m, level, c[w], k[at], w))
        _, at = np.unique(branch * len(key) + of, return_index=True)
        for b, x in split(branch[at]):
            x = at[x]
            x = x[np.argsort(word[x], kind="stable")]
            used, local = np.unique(word[x], return_inverse=True)
            row(0, b, packed(np.diff(every[used], prepend=np.uint64(0)), np.diff(local, prepend=0), context[x], k[of[x]]))
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "branch": pa.array(out["branch"], pa.int32()), "packed": pa.array(out["packed"], pa.binary()), "total": pa.array(out["total"], pa.int64()), "kinds": pa.array(out["kinds"], pa.int64())})

    return add


@dataclass
class Root:
    """The root's distribution, and the states of hot contexts by number."""

    total: int
    kinds: int
    counts: np.ndarray  # by id of the vocabulary; 0: no word
    n: np.ndarray
    left: np.ndarray
    stays: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        """P of words by their training counts; 1 if there is nothing to learn from."""
        return (c + 0.1) / (self.total + 0.1 * (self.kinds + 1)) if self.total else np.ones(len(c))

    def add(self, p: np.ndarray, context: np.ndarray, k: np.ndarray) -> np.ndarray:
        """P one level deeper, for positions in hot contexts with these totals of their words."""
        return np.where(self.stays[context], np.where(k >= LEAST, k, 0) / (self.n[context] + MASS) + self.left[context] * p, p)


def _states(of: np.ndarray, k: np.ndarray, n: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts leave to their parents, and which stay; ``of``, ``k``, ``parent``: kept continuations' contexts, counts and parents' P."""
    kept = np.bincount(of, k, minlength=len(n))
    left = (n - kept + MASS) / (n + MASS)
    p = k / (n[of] + MASS) + left[of] * parent
    gain = np.bincount(of, k * np.log2(p / parent), minlength=len(n)) + np.where(n > kept, (n - kept) * np.log2(left), 0)
    return left, gain > COST * (np.bincount(of, minlength=len(n)) + 1) * np.log2(n + 1)


def _root(totals: DataFrame, layout: Layout) -> tuple[Root, Layout]:
    """Sums that don't grow with the corpus but by its hot contexts (at most as many as there are branches), and the layout with more words."""
    total, kinds = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    counts = np.zeros(len(layout.words) + 1, np.int64)
    more, more_counts = [], []
    for r in totals.where("kind = 1").select("packed").collect():
        ids, c, names, others = unpacked(bytes(r.packed))
        counts[np.cumsum(ids)] = c
        more.append(np.cumsum(names.view(np.uint64), dtype=np.uint64))
        more_counts.append(others)
    if more:
        names, others = np.concatenate(more), np.concatenate(more_counts)
        order = np.lexsort((names, -others))
        counts = np.concatenate([counts, others[order]])
        layout = Layout(layout.branches, layout.depth, np.concatenate([layout.words, names[order]]), layout.hot, layout.up)
    number = 1 + sum(map(len, layout.hot))
    root = Root(total, kinds, counts, np.zeros(number), np.ones(number), np.zeros(number, bool))
    if number == 1:
        return root, layout
    hot = totals.where("kind = 2").select("packed")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                context, _, _, k, _ = unpacked(raw)
                got, of = np.unique(context, return_inverse=True)
                keep = k >= LEAST
                yield _rows({"context": (got, pa.int64()), "n": (np.bincount(of, k), pa.float64()), "kept": (np.bincount(of, k * keep), pa.float64()), "m": (np.bincount(of, keep), pa.float64())})

    kept, m = np.zeros(number), np.zeros(number)
    for r in hot.mapInArrow(sums, "context long, n double, kept double, m double").groupBy("context").agg(F.sum("n"), F.sum("kept"), F.sum("m")).collect():
        root.n[r[0]], kept[r[0]], m[r[0]] = r[1:]
    root.left = (root.n - kept + MASS) / (root.n + MASS)
    parent = np.concatenate([np.zeros(1, np.int64), *layout.up])
    for level, own in enumerate(layout.hot, 1):

        def gains(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    context, depth, c, k, w = unpacked(raw)
                    p = np.zeros(len(k))
                    for d in range(1, level + 1):  # the parent's P, from the root on
                        at = np.flatnonzero(depth == d)
                        if d == 1:
                            p[at] = root.base(c[at])
                        else:
                            up = parent[context[at]]
                            keys = context * (int(w.max()) + 1) + w
                            order = np.argsort(keys)
                            one = order[_find(keys[order], up * (int(w.max()) + 1) + w[at])]
                            p[at] = root.add(p[one], up, k[one])
                    at = np.flatnonzero((depth == level) & (k >= LEAST))
                    got, of = np.unique(context[at], return_inverse=True)
                    q = k[at] / (root.n[context[at]] + MASS) + root.left[context[at]] * p[at]
                    yield _rows({"context": (got, pa.int64()), "gain": (np.bincount(of, k[at] * np.log2(q / p[at]), minlength=len(got)), pa.float64())})

        gain = np.zeros(number)
        for r in hot.mapInArrow(gains, "context long, gain double").groupBy("context").agg(F.sum("gain")).collect():
            gain[r[0]] = r[1]
        here = np.arange(layout.starts[level], layout.starts[level] + len(own))
        rest = root.n[here] - kept[here]
        gain[here] += np.where(rest > 0, rest * np.log2(root.left[here]), 0)
        root.stays[here] = gain[here] > COST * (m[here] + 1) * np.log2(root.n[here] + 1)
    return root, layout


# ---- positions, scores


def _positions(layout: Layout, root: Root):
    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each branch of a group of documents; the documents' facts go with the first."""
        part, count = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
        for group in _groups(batches, GATHER_TOKENS):
            branch, *_ = layout.route(group)
            v = len(layout.words) + 1
            ids = layout.ids(group.names)
            common = ids[group.word] > 0
            c = root.counts[ids[group.word[common]]]
            facts = packed(
                np.array([i or 0 for i in group.ids], np.int64), np.array([i is None for i in group.ids]), group.held, group.sizes,
                np.bincount(group.of[common], np.log10(root.base(c)), minlength=len(group.ids)), np.bincount(group.of[common], c > 0, minlength=len(group.ids)).astype(np.int64),
            )
            ids = np.where(ids > 0, ids, v + np.arange(len(ids))).astype(np.int32)[group.word]
            back = [ids, *(_shifted(ids, group.place, k) for k in range(1, layout.depth + 1))]
            for b, at in split(branch):
                own = [x[at] for x in back]
                rare = np.unique(np.concatenate([x[x >= v] for x in own]))
                for x in own:
                    other = x >= v
                    x[other] = v + np.searchsorted(rare, x[other])
                blob = packed(np.diff(group.names[rare - v], prepend=np.uint64(0)), np.diff(group.of[at], prepend=0), group.learn[at], *own)
                yield _rows({"branch": ([b], pa.int32()), "group": ([(part << 36) + count], pa.int64()), "packed": ([blob], pa.binary()), "facts": ([facts], pa.binary())})
                facts = None
            count += 1

    return positions


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of keys, and a place of each different key."""
    order = np.argsort(keys)
    new = np.concatenate([[True], np.diff(keys[order]) != 0])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def _level(context: np.ndarray, word: np.ndarray, learn: np.ndarray, parent: np.ndarray, words: int) -> np.ndarray:
    """P by contexts (dense numbers) one word longer: where a context stays, from its counts, else as ``parent`` has it."""
    n = np.bincount(context, learn).astype(np.int64)
    entry, first = _ranked(context * words + word)
    k = np.bincount(entry, learn).astype(np.int64)
    keep = k >= LEAST
    left, stays = _states(context[first][keep], k[keep], n, parent[first][keep])
    return np.where(stays[context], np.where(keep, k, 0)[entry] / (n[context] + MASS) + left[context] * parent, parent)


def _fixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of logarithms as whole numbers of 2**-unit, the unit being 40 unless they are very large."""
    unit = min(40, 62 - math.ceil(math.log2(1 - x.min()))) if len(x) else 40
    return np.rint(-x * 2.0**unit).astype(np.int64), np.array([unit])


def _scorer(layout: Layout, root: Root):
    v = len(layout.words) + 1

    def deep(back: list[np.ndarray], learn: np.ndarray, p: np.ndarray, words: int, hashes: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """P by the longest contexts that stay, from P of the root."""
        at = np.arange(len(p))
        for level in range(1, layout.depth + 1):
            own = back[level][at] > 0
            at = at[own]
            if not len(at):
                break
            context = back[1][at].astype(np.int64) if level == 1 else _ranked(context[own] * words + back[level][at])[0]
            cold = np.ones(len(at), bool)
            if level <= len(layout.hot):
                name = hashes[back[1][at]]
                for d in range(2, level + 1):
                    name = _mix(name, hashes[back[d][at]])
                hot = _find(layout.hot[level - 1], name)
                cold, warm = hot < 0, at[hot >= 0]
                which = hot[~cold] + layout.starts[level]
                found = _find(keys, which * words + back[0][warm])
                p[warm] = root.add(p[warm], which, np.where(found >= 0, totals[found] if len(totals) else 0, 0))
            if cold.any():
                p[at[cold]] = _level(context[cold], back[0][at[cold]], learn[at[cold]], p[at[cold]], words)
        return p

    def score(positions: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        for raw in positions.column("packed"):
            p = unpacked(raw.as_py())
            parts.append([p[0], *(x.astype(np.int32) for x in p[1:])])
        asks = [unpacked(x) for x in asked.column("packed").to_pylist()]
        names = [np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts]
        asked_names = [np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in asks]
        if not parts:
            return pa.table({k: pa.array([], t) for k, t in (("group", pa.int64()), ("packed", pa.binary()), ("facts", pa.binary()))})
        asked_ids = [layout.ids(x) for x in asked_names]
        every = np.unique(np.concatenate([*names, *(x[i == 0] for x, i in zip(asked_names, asked_ids))]))
        words = v + len(every)
        for x, p in zip(names, parts):
            to = v + np.searchsorted(every, x)
            for own in p[3:]:
                other = own >= v
                own[other] = to[own[other] - v]
        back = [np.concatenate([p[3 + k] for p in parts]) for k in range(layout.depth + 1)]
        learn, parts = np.concatenate([p[2] for p in parts]).astype(bool), [p[1] for p in parts]
        hashes = np.concatenate([np.zeros(1, np.uint64), layout.words, every])

        c = np.concatenate([root.counts, np.zeros(len(every), np.int64)])
        keys, totals = [], []
        for x, i, p in zip(asked_names, asked_ids, asks):
            word = np.where(i > 0, i, v + np.searchsorted(every, x))[np.cumsum(p[1])]
            plain = p[2] == 0
            c[word[plain]] = p[3][plain]
            keys.append(p[2][~plain] * words + word[~plain])
            totals.append(p[3][~plain])
        keys, totals = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, totals))
        order = np.argsort(keys)
        keys, totals = keys[order], totals[order]

        w = back[0]
        p = root.base(c[w])
        base = np.log10(p)
        # contexts that share the last word, or the one before it if the last is hot, are dealt with together
        last = back[1] if not layout.hot else np.where(np.isin(hashes[back[1]], layout.hot[0]), back[2 % len(back)], back[1])
        for _, at in split((last % max(1, len(w) // STRETCH))):
            p[at] = deep([x[at] for x in back], learn[at], p[at], words, hashes, keys, totals)
        own = np.log10(p)
        out, done = [], 0
        for part in parts:
            doc = np.cumsum(part)
            here = slice(done, done + len(doc))
            done += len(doc)
            seen, of = np.unique(doc, return_inverse=True)
            rare = np.flatnonzero(w[here] >= v)
            with_rare, of_rare = np.unique(doc[rare], return_inverse=True)
            out.append(packed(np.diff(seen, prepend=0), *_fixed(np.bincount(of, own[here])), np.diff(with_rare, prepend=0), *_fixed(np.bincount(of_rare, base[here][rare])), np.bincount(of_rare, c[w[here][rare]] > 0).astype(np.int64)))
        return pa.table({"group": positions.column("group"), "packed": pa.array(out, pa.binary()), "facts": positions.column("facts")})

    return score


def _summed(table: pa.Table) -> pa.Table:
    """The documents of a group, with what all branches say of them."""
    facts = next(x for x in table.column("facts").to_pylist() if x is not None)
    ids, none, held, sizes, base, known = unpacked(facts)
    base, known, own = base.view(np.float64).copy(), known.copy(), np.zeros(len(ids))
    for raw in table.column("packed").to_pylist():
        doc, scores, unit, rare, bases, rare_unit, n = unpacked(raw)
        own[np.cumsum(doc)] -= scores / 2.0 ** unit[0]
        rare = np.cumsum(rare)
        base[rare] -= bases / 2.0 ** rare_unit[0]
        known[rare] += n
    doc_id = pa.array(ids, pa.int64(), mask=none.astype(bool))
    return pa.table({"doc_id": doc_id, "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(own)})


def scored(docs: DataFrame, depth: int = DEPTH, branch_tokens: int = BRANCH_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from the rows that aren't held out, contexts of up to ``depth`` words. Null texts
    are empty: one token, the end. A null doc_id counts as an empty id. Repeated rows learn and score
    each for itself. Without training tokens every probability is 1. An empty table gives no rows.
    ``docs`` must read the same each time; its other columns aren't read.
    """
    rows = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    layout = _layout(rows, depth, branch_tokens)
    buckets = layout.branches
    totals = rows.mapInArrow(_asked(layout, buckets), "bucket int, packed binary").groupBy("bucket").applyInArrow(_totals(layout), _TOTALS)
    totals = written(totals, "totals")
    root, layout = _root(totals, layout)
    placed = rows.mapInArrow(_positions(layout, root), "branch int, group long, packed binary, facts binary")
    asked = totals.where("kind = 0").select("branch", "packed")
    parts = placed.groupBy("branch").cogroup(asked.groupBy("branch")).applyInArrow(_scorer(layout, root), "group long, packed binary, facts binary")
    out = parts.groupBy("group").applyInArrow(_summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(root.total).cast("long").alias("train_tokens"), "base_score", "score")
