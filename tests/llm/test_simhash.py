import random
import re

import xxhash
from pyspark.sql import functions as F

from lockfleet.llm import simhash
from lockfleet.llm.graph import components, skew_join

SCHEMA = "fp string, doc_id long, text string, component_id int"


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, ids):
    """Component ids of fingerprints by comparing all pairs."""
    seen = [None] * len(fps)
    for i in range(len(fps)):
        if seen[i] is None:
            group, todo = [], [i]
            seen[i] = i
            while todo:
                a = todo.pop()
                group.append(a)
                for b in range(len(fps)):
                    if seen[b] is None and (fps[a] ^ fps[b]).bit_count() <= 3:
                        seen[b] = i
                        todo.append(b)
            least = min((ids[g] for g in group if ids[g] is not None), default=None)
            for g in group:
                seen[g] = (least,)
    return [x[0] for x in seen]


def test_against_all_pairs(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    texts += [None, "", "  \n", "A b", "a B", "É", "Word " * 5000, texts[3], texts[3].upper()]
    rows = [("x", i, t, 1) for i, t in enumerate(texts)] + [("x", 5, texts[5], 1), ("x", None, texts[7], 1), ("x", None, "alone with no id", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain(r[2]) for r in rows]
    want = sorted(((r[1], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute(fps, [r[1] for r in rows]))), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_links_whatever_the_bucket(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = set()
    for _ in range(250):  # a crowd around a centre, chains, and strangers
        x = centre
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        fps.add(x ^ 1 << rng.randrange(64) ^ 1 << 63)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    want = brute(fps, list(range(len(fps))))
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (256, 3):
        roots = dict(map(tuple, components(simhash.links(table, bucket)).collect()))
        group = [roots.get(x, x) for x in signed]
        assert len({*zip(group, want)}) == len(set(group)) == len(set(want))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_skewed_join(spark):
    big = spark.range(20000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 900)).alias("k"), "id").unionByName(spark.range(5).select(F.lit(None).cast("long").alias("k"), "id"))
    small = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        a, b = skew_join(big, small, "k", how), big.join(small, "k", how)
        assert a.count() == b.count() and a.agg(F.sum("v")).first() == b.agg(F.sum("v")).first()


def test_empty(spark):
    got = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0
