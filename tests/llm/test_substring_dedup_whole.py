import random
from collections import defaultdict

from lockfleet.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def test_crowded_bands_lose_no_pair(spark):
    """Of a value with 30 sets each that isn't like the first meets all others, in bounded groups."""
    near = [(1, i, i % 3 == 0) for i in range(30)]
    groups = defaultdict(set)
    for r in sd.blocks(spark.createDataFrame(near, "value long, ident long, near boolean"), 5).collect():
        groups[r.value].add(r.ident)
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert met >= {(a, b) for a in range(30) for b in range(a + 1, 30) if a % 3 or b % 3}
    assert max(map(len, groups.values())) < 25


def _lines(text):
    """Lines and blocks of 25 words or more, by the description."""
    out, block = [], []
    for line in [*text.split("\n"), ""]:
        own = line.split()
        if len(own) >= 25:
            out.append(own)
        if own and len(own) < 25:
            block.append(own)
            continue
        if len(block) > 1 and sum(map(len, block)) >= 25:
            out.append([w for x in block for w in x])
        block = []
    return out


def _jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_lines_against_all_pairs(spark):
    """Every pair of lines is compared: linked pairs are found, and what is classed together is connected by such pairs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(3))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randrange(25, 90))]
        for j in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.choice([0, 1, 2, len(own) - 1, len(own) - 2, rng.randrange(len(own))])] = word()
            text = " ".join(own) if j % 2 else "\n".join(" ".join(own[k : k + 11]) for k in range(0, len(own), 11))
            rows.append((10 * i + j, f"{' '.join(word() for _ in range(30))}\n\n{text}\n"))
    lines = [(i, x) for i, t in rows for x in _lines(t)]
    truth = {(i, tuple(x)): {(i, tuple(x))} for i, x in lines}
    pairs = [(a, b) for n, a in enumerate(lines) for b in lines[:n] if a[0] != b[0] and _jaccard(a[1], b[1]) >= 0.8 - 1e-9]
    for (i, x), (j, y) in pairs:
        a, b = truth[i, tuple(x)], truth[j, tuple(y)]
        if a is not b:
            a |= b
            for k in b:
                truth[k] = a
    words = {i: t.split() for i, t in rows}
    got = defaultdict(set)
    for crowd in (1000, 3):
        got.clear()
        for r in sd.repeated(spark.createDataFrame(rows, SCHEMA), crowd).collect():
            line = (r.doc_id, tuple(words[r.doc_id][r.first_word : r.first_word + r.n_words]))
            if line in truth:
                got[line].add(r.class_id)
        linked = [bool(got[i, tuple(x)] & got[j, tuple(y)]) for (i, x), (j, y) in pairs]
        assert len(pairs) > 80 and sum(linked) >= 0.98 * len(pairs)
        by_class = defaultdict(set)
        for line, ids in got.items():
            for c in ids:
                by_class[c].add(line)
        for members in by_class.values():  # a run of passages may be a whole line by itself; then its words are the same
            first = min(members)
            assert all(m in truth[first] or _jaccard(m[1], first[1]) >= 0.8 for m in members)


def test_runs_against_all_stretches(spark):
    """Each stretch of 25 words in an earlier document goes, what stays in is no such stretch's, and what goes is in an earlier document."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(400)}"
    pool = [[word() for _ in range(rng.randrange(10, 90))] for _ in range(25)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(4):
            own += [word() for _ in range(rng.randrange(5, 40))]
            piece = rng.choice(pool)
            a = rng.randrange(len(piece))
            own += piece[a : a + rng.randrange(10, 60)]
        rows.append((i, " ".join(own)))
    out = {r.doc_id: r.text.split() for r in sd.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    total = 0
    before: dict[tuple, int] = {}
    short: dict[tuple, int] = {}
    for i, text in rows:
        w = text.split()
        shared = [False] * len(w)
        some = [False] * len(w)
        for k in range(len(w) - 24):
            if before.get(tuple(w[k : k + 25]), i) < i:
                shared[k : k + 25] = [True] * 25
        for k in range(len(w) - 12):
            if short.get(tuple(w[k : k + 13]), i) < i:
                some[k : k + 13] = [True] * 13
        for k in range(len(w) - 24):
            before.setdefault(tuple(w[k : k + 25]), i)
        for k in range(len(w) - 12):
            short.setdefault(tuple(w[k : k + 13]), i)
        left = out.get(i, [])
        must = [x for x, s in zip(w, some) if not s]
        it = iter(left)
        assert all(any(x == y for y in it) for x in must), i  # what no earlier document has stays, in order
        total += sum(shared)
        assert len(must) <= len(left) <= len(w)
        if not any(some):
            assert left == w
    gone = sum(len(t.split()) for _, t in rows) - sum(map(len, out.values()))
    assert total > 1000 and gone >= 0.99 * total, (gone, total)


def test_near_copies_within_longer_lines(spark):
    """One word of 51 changed, anywhere: both sides of 25 words or more go from the later copy."""
    rng = random.Random(14)
    say = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, kept = [], {}
    for k in range(51):
        passage, other = say(51), say(1)
        lead, tail = say(rng.randrange(20, 60)), say(rng.randrange(20, 60))
        near = [*passage[:k], *other, *passage[k + 1 :]]
        rows += [(10 * k, " ".join(say(30) + passage + say(30))), (10 * k + 1, " ".join(lead + near + tail))]
        kept[10 * k + 1] = lead + (passage[:k] if k < 25 else []) + other + (passage[k + 1 :] if k > 25 else []) + tail
    out = {r.doc_id: r.text.split() for r in sd.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: out[i] for i in kept} == kept


def test_passages_go_whole(spark):
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, passages = [], []
    for k in range(60):
        passage = say(51) if k % 4 else say(4) * 13  # some repeat with a period of four
        passages.append(set(passage))
        rows += [(10 * k + i, " ".join(say(rng.randrange(30, 60)) + passage + say(rng.randrange(30, 60)))) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text.split() for r in sd.without_repeats(docs).collect()}
    for i, text in rows:
        before = text.split()
        assert out[i] == (before if i % 10 == 0 else [w for w in before if w not in passages[i // 10]])
    for r in sd.repeated(docs).collect():
        span = rows[3 * (r.doc_id // 10) + r.doc_id % 10][1].split()[r.first_word : r.first_word + r.n_words]
        assert set(span) <= passages[r.doc_id // 10]


def test_what_goes_stays_in_an_earlier_document(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    whole = say(120)
    rows = [(0, say(40) + whole[30:62] + say(40)), (1, say(40) + whole + say(40)), (2, say(50) + whole + say(50))]
    out = {r.doc_id: r.text.split() for r in sd.without_repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()}
    assert set(whole) <= {w for t in out.values() for w in t}
    assert out[2] == [w for w in rows[2][1] if w not in set(whole)]


def test_hard_wrapped_near_copies_are_linked(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    rows = []
    for k in (20, 24, 28, 32, 36):  # one word changed near the middle
        words = say(60)
        near = [*words[:k], *say(1), *words[k + 1 :]]
        rows += [(10 * k, wrap(words, 12) + "\n\n" + " ".join(say(30))), (10 * k + 1, " ".join(say(40)) + "\n\n" + wrap(near, 11))]
    groups = defaultdict(set)
    for r in sd.repeated(spark.createDataFrame(rows, SCHEMA)).where("n_words = 60").collect():
        groups[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == {frozenset((10 * k, 10 * k + 1)) for k in (20, 24, 28, 32, 36)}
