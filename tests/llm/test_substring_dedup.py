import random
from collections import defaultdict

import pytest

from lockfleet.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, tag int, n_chars long, spans string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    passage, line = say(52), say(40)
    rows = [(i, "\n".join(say(rng.randrange(20, 60)) for _ in range(3))) for i in range(20)]
    for i in (100, 101, 102):  # a passage within lines of other words
        rows.append((i, f"{say(33)} {passage} {say(21)}\n{say(30)}"))
    near = line.split()
    near[1] = "other"
    rows += [(200, say(30) + "\n" + line), (201, say(25) + "\n" + " ".join(near) + "\n" + say(26))]
    rows += [(300, say(80)), (301, None), (302, ""), (303, "a b"), (304, " \n "), (None, passage), (305, (say(30) + "\n") * 4)]
    rows += [(306, rows[0][1]), (306, rows[0][1])]
    return [(i, t, 1, len(t or ""), "x") for i, t in rows]


def test_rows_and_removals(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = sd.repeated(docs).collect()
    assert {r.doc_id for r in got} == {0, 306, 100, 101, 102, 200, 201}
    groups = defaultdict(set)
    for r in got:
        groups[r.class_id].add(r.doc_id)
        assert r.removed == (r.doc_id != r.keeper_doc_id)
    assert {frozenset(g) for g in groups.values()} == {frozenset(x) for x in ({0, 306}, {100, 101, 102}, {200, 201})}
    out = {r.doc_id: r for r in sd.without_repeats(docs).collect()}
    before = {r[0]: r for r in corpus}
    changed = {i for i in out if i in before and out[i].text != before[i][1]}
    assert changed == {101, 102, 201} and 306 not in out and set(out) == set(before) - {306}
    assert all(out[i].n_chars == len(out[i].text) < len(before[i][1]) for i in changed)
    assert sd.without_repeats(docs).columns == docs.columns


def test_crowded_bands_are_split_not_dropped(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(40):
        own = list(base)
        own[rng.choice([0, 59])] = word()
        rows.append((i, " ".join(own), 0, 0, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    for crowd in (400, 5):
        got = sd.repeated(docs, crowd).collect()
        whole = [r for r in got if r.n_words == 60]
        assert {r.doc_id for r in whole} == set(range(40)) and len({r.class_id for r in whole}) == 1


def test_anchors_follow_the_passage():
    rng = random.Random(7)
    say = lambda n: [str(rng.random()).encode() for _ in range(n)]
    caught = 0
    for _ in range(200):
        passage = say(25)
        seen = []
        for _ in range(2):
            before = say(rng.randrange(40))
            at = sd.Parsed([b" ".join(say(20)), b" ".join(before + passage + say(30))])
            at = at.anchors[at.doc[at.anchors] == 1] - 20
            seen.append({int(x) - len(before) for x in at if 0 <= x - len(before) <= 25 - sd.PASSAGE_WORDS})
        caught += bool(seen[0] & seen[1])
    assert caught == 200


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert sd.repeated(docs).count() == 0 and sd.without_repeats(docs).count() == 0
