import hashlib
import random
import re

from lockfleet.llm import decontaminate as d

DOCS, ITEMS = "item_ids int, doc_id long, text string, word_count string", "text string, item_id long, doc_id int"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for t, i, _ in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for _, doc_id, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if got := wins.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= got - {None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "the", "É", "x1"]) for _ in range(n))
    items = [(say(n), i, 0) for i, n in enumerate([1, 3, 13, 14, 40, 60, 12])]
    items += [(None, 7, 0), ("", 8, 0), ("...", 9, 0), (items[4][0], 10, 0), (items[4][0], 4, 0), ("zz yy", None, 0), ("a " * 13, 11, 0)]
    texts = [say(n) for n in (0, 1, 5, 100, 400)] + [None, "", "-- !", "A-" + items[4][0].upper() + ".", say(50) + " " + items[5][0] + " " + say(600), "ZZ,yy", "a " * 5000, "un" + items[4][0]]
    docs = [(1, i, t, "w") for i, t in enumerate(texts)] + [(1, None, items[4][0], "w"), (1, 4, texts[4], "w")]
    return docs, items


def test_against_brute_force_in_one_block_and_in_many(spark):
    docs, items = data()
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for block in (4_000_000, 100):
        assert sorted(map(tuple, d.report(a, b, block_bytes=block).collect()), key=str) == brute(docs, items)
    kept = d.decontaminated(a, b)
    assert kept.columns == a.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x[0] for x in brute(docs, items) if not x[5]), key=str)


def test_empty(spark):
    docs, items = data()
    none = spark.createDataFrame([], DOCS)
    assert d.report(none, spark.createDataFrame(items, ITEMS)).count() == 0
    got = d.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect()
    assert len(got) == len(docs) and not any(r.n_hit or r.contaminated for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(0, 1, "one x x two y three", ""), (0, 2, "three one two", ""), (0, 3, "one two", ""), (0, 4, None, ""), (0, 5, "one " + "x " * 30 + "two three", "")], DOCS)
    got = sorted(map(tuple, d.proximity(docs, [(7, "Three ONE two"), (8, "absent"), (9, "one one")], 6).collect()))
    assert got == [(1, 7), (1, 9), (2, 7), (2, 9), (3, 9), (5, 9)]
