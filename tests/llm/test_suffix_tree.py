import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lockfleet.llm import suffix_tree as st
from lockfleet.llm.arrow import packed, unpacked

SCHEMA = "key string, doc_id long, n_tokens int, text string, held_out int"


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def rows():
    rng = random.Random(4)
    follow = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}

    def say(n):
        w = ["a"]
        for _ in range(n):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else rng.choice("abcdefghij"))
        return " ".join(w)

    texts = [say(rng.randrange(5, 60)) for _ in range(80)] + [None, "", " \n", "A Rare-Word-%d" % 1, "É é", "other words"]
    out = [("k", i, 0, t, 1) for i, t in enumerate(texts)]
    return out + [out[3], out[11], ("k", None, 0, "no id", 1), ("k", 900, 0, texts[3], 1)]


def test_base_counts_and_held_out_gain(spark):
    data = rows()
    got = st.scored(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for _, i, _, t, _ in data if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for _, i, _, t, _ in data)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_nothing_to_learn_from(spark):
    assert st.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(1000) if st.held_out(i))
    r = st.scored(spark.createDataFrame([("k", held, 0, "a b", 0)], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)



def test_columns_come_back(spark):
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 2**63, 500), rng.integers(0, 50, 3000), np.array([-1, 5, -(2**63)]), np.empty(0, np.int64), rng.normal(size=9)]
    got = unpacked(packed(*columns))
    assert all((a.view(b.dtype) == b).all() and len(a) == len(b) for a, b in zip(got, columns))
