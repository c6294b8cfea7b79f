import hashlib
import random
import zlib

import numpy as np

from lockfleet.llm import periodic as P
from lockfleet.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(words, least=6, exponent=4):
    """All runs, by comparing the words with themselves at each distance."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w, out = np.array([ids[x] for x in words], np.int64), []
    for q in range(1, len(w) // exponent + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], w[:-q] == w[q:], [0]])))
        for i, j in zip(same[::2].tolist(), same[1::2].tolist()):
            size = j - i + q
            if size >= max(least, exponent * q) and not any((w[i : i + size - d] == w[i + d : i + size]).all() for d in range(1, q)):
                out.append((i, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(rng, size):
    kinds = rng.choice([1, 2, 2, 3, 5, 30])
    w = [rng.randrange(kinds) for _ in range(rng.randrange(size))]
    if w and rng.random() < 0.5:
        a, p = rng.randrange(len(w)), rng.randrange(1, len(w) // 3 + 2)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def test_runs_equal_the_plain_form():
    rng = random.Random(1)
    for _ in range(1500):
        w = texts(rng, 60)
        for least, exponent in ((2, 2), (6, 4)):
            assert list(map(tuple, P.runs_of(np.array(w, np.int64), least, exponent).tolist())) == plain(w, least, exponent), w


def test_batches_and_larger_texts():
    rng = random.Random(2)
    for size in (90, 90, 90, 3000):
        docs = [texts(rng, size) for _ in range(12)] + [[0] * 50, [0, 1] * 40 + [0, 0] * 20, []]
        got = P.runs_in([[b"%d" % x for x in d] for d in docs])
        assert [list(map(tuple, r.tolist())) for r in got] == [plain(d) for d in docs]


def test_blocks_are_lempel_ziv():
    word = [0, 1, 0, 1, 0, 1, 2, 0, 0, 0]
    assert P.SuffixTree(np.array(word)).blocks().tolist() == [0, 1, 2, 6, 7, 8]


def test_places_in_the_tree():
    rng = random.Random(3)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(rng.randrange(2, 50))]
        tree = P.SuffixTree(np.array(w))
        assert tree.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        for i in range(len(w)):
            size = rng.randrange(1, len(w) - i + 1)
            (low,), (high,) = tree.below(np.array([i]), np.array([size]))
            assert sorted(tree.order[low:high].tolist()) == [j for j in range(len(w)) if w[j : j + size] == w[i : i + size]]


def test_query_on_whole_documents(spark):
    want = []
    for doc_id, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = QUERIES["op13_periodic_runs"](spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[1] for r in want)


def test_nulls_repeats_clashes_and_nothing(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "a b " * 5, 3), (2, "x " + "a b " * 5 + "y", 4), (2, "x " + "a b " * 5 + "y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs int")
    out = P.found(df)
    assert out.columns == ["doc_id", "text", "Runs", "_runs", "collapsed"]
    got = sorted((r.Runs, [tuple(x) for x in r["_runs"]], r.collapsed) for r in out.collect())
    assert got == [(1, [], ""), (2, [], ""), (3, [(0, 10, 2)], "a b"), (4, [(1, 10, 2)], "x a b y"), (4, [(1, 10, 2)], "x a b y")]
    assert P.repeated(df).columns == df.columns and P.repeated(df).count() == 5
    none = df.where("false")
    assert P.found(none).collect() == P.digests(none).collect() == P.digests(P.repeated(none)).collect() == []


def test_ties_go_to_the_least_start(spark):
    df = spark.createDataFrame([(1, "a b " * 4 + "c d " * 4 + "e " * 5)], "doc_id long, text string")
    r = P.digests(df).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 0, 8, 2, 4000)


def test_a_very_long_text():
    rng = random.Random(4)
    words = [b"%d" % rng.randrange(50) for _ in range(40_000)]
    words = words + words[-9000:] * 4 + [b"z"] * 30_000
    (runs,) = P.runs_in([words])
    assert (31_000, 45_000, 9000) in set(map(tuple, runs.tolist())) and (76_000, 30_000, 1) in set(map(tuple, runs.tolist()))
