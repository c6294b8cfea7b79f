"""Quality rules: a decision list learned by sequential covering.

Labelled documents give statistics; rules are grown one by one as conjunctions of thresholds (best
FOIL gain on the growing part), pruned from their end (best (p - n) / (p + n) on the pruning part), and
the documents that a rule covers are set aside before the next. The list becomes one ordered Spark
CASE WHEN expression over statistics columns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.arrow import appended, batched, fresh, slices
from lockfleet.llm.sample import least_hashed

#: Most labelled rows that the list is fitted on: those of least hash.
SAMPLE = 20_000
#: A rule must be right this often, on the pruning part too.
PRECISION = 0.95
#: Most rules of a list, terms of a rule, and cuts between values that are tried for a term: what keeps the list readable.
MAX_RULES, MAX_TERMS, CUTS = 12, 4, 48

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stops", "n_distinct"]

# Frequent function words of the four languages of the documents.
STOPS = frozenset("the of and to in a is that for it as was with be by on de la le et les des en un du une que est der die und den von zu das mit sich ist el los las y por con del se".encode().split())

_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def statistics(raw: bytes | None) -> tuple[int, ...]:
    """The statistics of a text, in the order of STATS. Null has no words and no lines."""
    text = raw or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
    symbols = sum(map(joined.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    dup = len(lines) - len(set(lines))
    repeat = 0
    triples = set(zip(words, words[1:], words[2:]))
    if n > 3 and len(triples) < n - 2:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        m = len(ids)
        _, pair = np.unique(at[:-1] * m + at[1:], return_inverse=True)
        _, inverse, counts = np.unique(pair[:-1] * m + at[2:], return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        repeat = int(hit.sum())
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = joined.count(b"!") + joined.count(b"?")
    distinct = set(words)
    stops = sum(1 for w in words if w in STOPS)
    return n, chars, symbols, dup, repeat, len(lines), upper, marks, stops, len(distinct)


def with_statistics(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the statistics of each text as long columns, and their names (underscored on clashes)."""
    names = {s: fresh(docs.columns, s) for s in STATS}
    docs = batched(docs).withColumn("text", F.col("text").cast("string"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                columns = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), len(STATS))
                yield appended(part, **{names[s]: pa.array(columns[:, k]) for k, s in enumerate(STATS)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{names[s]}` bigint" for s in STATS)])
    return docs.mapInArrow(measure, schema), names


def _ratios(get) -> dict:
    """The features that thresholds are put on, from statistics columns or arrays alike."""
    n = get("n_words") + 1.0
    return {
        "words": n,
        "chars_per_word": get("word_chars") / n,
        "symbols_per_word": get("n_symbols") / n,
        "marks_per_word": get("n_marks") / n,
        "upper_per_word": get("n_upper") / n,
        "repeats_per_word": get("n_repeat_words") / n,
        "stops_per_word": get("n_stops") / n,
        "distinct_per_word": get("n_distinct") / n,
        "dup_lines_per_line": get("n_dup_lines") / (get("n_lines") + 1.0),
        "words_per_line": n / (get("n_lines") + 1.0),
    }


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.feature] > F.lit(self.cut) if self.above else x[self.feature] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Term, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.mask(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_terms: int, max_cuts: int) -> Rule:
    """Adds the term of best FOIL gain until no good document is covered."""
    rule: Rule = ()
    live = np.ones(len(bad), bool)
    while len(rule) < max_terms and bad[live].any() and not bad[live].all():
        y = bad[live]
        before = np.log2(y.mean())
        best = (1e-9, None, None)
        for name, values in x.items():
            v = values[live]
            order = np.argsort(v, kind="stable")
            s, p = v[order], np.cumsum(y[order])
            ends = np.flatnonzero(s[1:] > s[:-1])  # a cut between different values
            if len(ends) > max_cuts:  # rank cuts, and the ends of the range in full
                ends = np.unique(np.concatenate([ends[:16], ends[-16:], ends[np.linspace(0, len(ends) - 1, max_cuts).astype(int)]]))
            cuts = (s[ends] + s[ends + 1]) / 2
            for above in (False, True):
                pos = p[-1] - p[ends] if above else p[ends]
                size = len(s) - ends - 1 if above else ends + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / size) - before), -1)
                k = int(gain.argmax()) if len(gain) else -1
                if k >= 0 and gain[k] > best[0]:
                    term = Term(name, above, float(cuts[k]))
                    best = (gain[k], term, None)
        if best[1] is None:
            break
        rule += (best[1],)
        live &= best[1].mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is best on the pruning part; the shorter on ties."""

    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn(stats: np.ndarray, bad: np.ndarray, precision: float = PRECISION, max_rules: int = MAX_RULES, max_terms: int = MAX_TERMS, max_cuts: int = CUTS) -> list[Rule]:
    """The decision list: each rule rejects what it covers; what none covers is kept.

    ``stats`` has a row for each labelled document with the columns of STATS. Every third row is for
    pruning. Without rejected or without kept examples the list is empty. ``max_rules``, ``max_terms`` and ``max_cuts`` bound the
    list: what is learnt, not what it is applied to.
    """
    x = _ratios(lambda s: stats[:, STATS.index(s)].astype(float))
    part = np.arange(len(bad)) % 3 == 2
    left, rules, barred = np.ones(len(bad), bool), [], set()
    while len(rules) < max_rules and len(barred) < len(x):
        g, p = left & ~part, left & part
        if bad[g].sum() < 3 or not (~bad[g]).any():
            break
        grown = _grow({k: v[g] for k, v in x.items() if k not in barred}, bad[g], max_terms, max_cuts)
        if not grown:
            break
        for rule in (_prune(grown, {k: v[p] for k, v in x.items()}, bad[p]), grown):
            hit = _covers(rule, x, len(bad))
            right = min(bad[hit & m].mean() if (hit & m).any() else 0.0 for m in (g, p))
            if right >= precision:
                break
        if right < precision:  # try again without the feature that led here
            barred.add(grown[0].feature)
            continue
        rules.append(rule)
        left &= ~hit
        barred.clear()
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and rejection (quality 0) of at most ``sample`` labelled rows, those of least hash of doc_id.

    The sample's bound is what makes it safe to broadcast to the documents and to bring to the driver.
    """
    few = least_hashed(labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id", sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")
    measured, names = with_statistics(chosen)
    # one row for each id, however often it is repeated, in an order that ids don't set
    one = measured.groupBy("doc_id").agg(F.min(F.struct("quality", *names.values())).alias("x"))
    rows = sorted(one.select("doc_id", "x.*").collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    return np.array([r[2:] for r in rows], np.int64).reshape(len(rows), len(STATS)), np.array([r[1] == 0 for r in rows], bool)


def verdict(rules: list[Rule], names: dict[str, str]) -> Column:
    """The list as one Spark expression: false where a rule rejects, else true."""
    x = _ratios(lambda s: F.col(names[s]).cast("double"))
    out: Column | None = None
    for rule in rules:
        hit = F.lit(True)
        for t in rule:
            hit = hit & t.column(x)
        out = (F.when if out is None else out.when)(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(names: dict[str, str]) -> Column:
    n = F.col(names["n_words"])
    return (n < 50) | (100 * F.col(names["n_repeat_words"]) > 50 * n)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row.

    Null and empty texts have no words and fail. Documents without labels are judged like all others.
    """
    rules = learn(*labelled(docs, labels, sample))
    measured, names = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    failed = base_failed(names)
    return measured.select("doc_id", *STATS[:5], failed.alias("base_failed"), (~failed & verdict(rules, names)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    rules = learn(*labelled(docs, labels, sample))
    measured, names = with_statistics(docs)
    return measured.where(~base_failed(names) & verdict(rules, names)).select(*[F.col(f"`{c}`") for c in docs.columns])
