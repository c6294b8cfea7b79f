import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lockfleet.llm import quality as q

DOCS, LABELS = "kept string, doc_id long, text string, n_words int", "toxic int, quality int, doc_id long"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, hit = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def corpus():
    rng = random.Random(8)
    say = lambda n, end="": " ".join("".join(rng.choice("abcdeghé") for _ in range(rng.randrange(2, 8))) + end for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append(("k", i, say(rng.randrange(60, 200), "$$$" if bad else ""), 0))
        labels.append((0, 0 if bad else 1, i))
    rows += [("k", 500, None, 0), ("k", 501, "", 0), ("k", 502, "a\n\na\n \na b\n", 0), ("k", 503, "x y z " * 40, 0), ("k", None, say(80), 0), ("k", 504, "a b a b a", 0), ("k", 505, "  \n\n\v", 0), ("k", 506, say(30000), 0), rows[0]]
    labels += [(0, None, 3), (1, 1, None), (0, 0, 12345), labels[0]]
    return rows, labels


def test_statistics_and_verdicts(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = q.judged(docs, marks).collect()
    assert len(got) == len(rows)
    want = {(i, t): brute(t) for _, i, t, _ in rows}
    by_id = {i: want[i, t] for _, i, t, _ in rows}
    for r in got:
        assert tuple(r)[1:7] == by_id[r.doc_id]
        if r.doc_id is not None and r.doc_id < 240:
            assert r.kept == (r.doc_id % 6 > 0)
        assert not (r.kept and r.base_failed)
    kept = q.kept(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    again = q.learn(*q.labelled(docs, marks))
    assert again == q.learn(*q.labelled(docs, marks)) and again and all(str(t) for rule in again for t in rule)


def test_expression_is_the_list(spark):
    rng = np.random.default_rng(3)
    stats = rng.integers(1, 300, (600, len(q.STATS)))
    bad = (stats[:, 2] / (stats[:, 0] + 1.0) > 1.5) | (stats[:, 5] < 20)
    rules = q.learn(stats, bad, precision=0.9)
    assert rules
    df = spark.createDataFrame([tuple(map(int, r)) for r in stats], ", ".join(f"{s} long" for s in q.STATS)).withColumn("i", F.monotonically_increasing_id())
    got = [r[0] for r in df.orderBy("i").select(q.verdict(rules, {s: s for s in q.STATS})).collect()]
    x = q._ratios(lambda s: stats[:, q.STATS.index(s)].astype(float))
    hit = np.zeros(len(stats), bool)
    for rule in rules:
        hit |= q._covers(rule, x, len(stats))
    assert got == (~hit).tolist() and (hit & ~bad).sum() <= 0.1 * hit.sum()


def test_held_out_accuracy():
    rng = np.random.default_rng(4)
    stats = rng.integers(1, 400, (4000, len(q.STATS)))
    bad = stats[:, 4] / (stats[:, 0] + 1.0) > 2.0
    rules = q.learn(stats[:2000], bad[:2000])
    x = q._ratios(lambda s: stats[2000:, q.STATS.index(s)].astype(float))
    hit = np.zeros(2000, bool)
    for rule in rules:
        hit |= q._covers(rule, x, 2000)
    assert (hit == bad[2000:]).mean() > 0.97


def test_empty_tables(spark):
    rows, labels = corpus()
    none, docs = spark.createDataFrame([], DOCS), spark.createDataFrame(rows, DOCS)
    assert q.judged(none, spark.createDataFrame(labels, LABELS)).count() == 0
    got = q.judged(docs, spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept != r.base_failed for r in got)
