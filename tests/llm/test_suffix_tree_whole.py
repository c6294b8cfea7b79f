import math
import random
from collections import Counter

import pytest

from lockfleet.llm import suffix_tree as st

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    follow = {(a, b): rng.sample(words, 2) for a in words for b in words}
    rows = []
    for i in range(300):
        w = rng.sample(words, 2)
        for _ in range(rng.randrange(60)):
            w.append("the" if rng.random() < 0.2 else rng.choice(follow.get((w[-2], w[-1]), words)))
        rows.append((i, " ".join(w)))
    return [*rows, rows[0], (None, "w1 w2 w3"), (901, None), (902, "")]


def expected(data, depth):
    """Scores by a plain tree of dictionaries."""
    learnt = [st.tokens(t and t.encode()) for i, t in data if not st.held_out(i)]
    c = Counter(w for x in learnt for w in x)
    total, kinds = sum(c.values()), len(c)
    nexts: dict[tuple, Counter] = {}
    for x in learnt:
        for t in range(len(x)):
            for n in range(1, min(depth, t) + 1):
                nexts.setdefault(tuple(x[t - n : t]), Counter())[x[t]] += 1
    memo: dict = {}

    def p(s, w):
        if not s:
            return (c[w] + 0.1) / (total + 0.1 * (kinds + 1))
        if s not in memo:
            own = nexts.get(s, Counter())
            n = sum(own.values())
            keep = {x: k for x, k in own.items() if k >= 2}
            left = (n - sum(keep.values()) + 4) / (n + 4)
            gain = sum(k * math.log2((k / (n + 4) + left * p(s[1:], x)) / p(s[1:], x)) for x, k in keep.items())
            gain += (n - sum(keep.values())) * math.log2(left)
            memo[s] = n, keep, left, gain > 0.5 * (len(keep) + 1) * math.log2(n + 1)
        n, keep, left, stays = memo[s]
        return keep.get(w, 0) / (n + 4) + left * p(s[1:], w) if stays else p(s[1:], w)

    out = []
    for i, t in data:
        x = st.tokens(t and t.encode())
        out.append((-1 if i is None else i, round(sum(math.log10(p(tuple(x[max(0, k - depth) : k]), x[k])) for k in range(len(x))), 6)))
    return sorted(out), sum(m[3] for s, m in memo.items() if len(s) == 3)


@pytest.mark.parametrize("branch_tokens", [2_000_000, 500, 60])
def test_every_context_counts_however_rare(spark, data, branch_tokens):
    want, deep = expected(data, 3)
    assert deep > 0
    got = st.scored(spark.createDataFrame(data, SCHEMA), branch_tokens=branch_tokens).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in got) == want
