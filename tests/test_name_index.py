import random

from pyspark.sql import functions as F

from lockfleet.operators import similarity
from lockfleet.operators.name_index import NameIndex


def corpus(spark, names):
    return spark.createDataFrame([(e, n) for n in names for e in ("npm", "pypi")], "ecosystem string, name string")


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abc-") for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_refreshed_index_equals_the_join(spark, tmp_path):
    """Names that come, go and come back; refreshed by what differs, and opened again."""
    path, names = f"file://{tmp_path}/index", words(1, 120)
    asked = spark.createDataFrame([("npm", n) for n in set(words(2, 150))] + [("cargo", "abcabcab"), ("npm", None)], "ecosystem string, norm string")
    empty = NameIndex(spark, path, 4)
    assert empty.nearest(asked).count() == 0 and empty.names().count() == 0
    for known in (names[:80], names[40:] + names[40:60], [], names[:100]):
        index = NameIndex(spark, path, 4)
        index.refresh(corpus(spark, known))
        assert {tuple(r) for r in index.names().collect()} == {tuple(r) for r in corpus(spark, known or ["-"]).distinct().collect() if known}
        want = similarity.nearest(asked, corpus(spark, known or ["a"]))
        assert sorted(map(tuple, index.nearest(asked).collect())) == sorted(map(tuple, want.collect()))


def test_refresh_writes_what_differs(spark, tmp_path):
    index = NameIndex(spark, f"file://{tmp_path}/index", 4)
    index.refresh(corpus(spark, ["abcdefgh", "ijklmnop"]))
    stored, log = (spark.table(x).count() for x in (index.variants, index.log))
    index.refresh(corpus(spark, ["abcdefgh", "ijklmnop"]).union(spark.createDataFrame([("npm", None)], "a string, b string")))
    assert (stored, log) == tuple(spark.table(x).count() for x in (index.variants, index.log))
    index.refresh(corpus(spark, ["abcdefgh"]))
    index.refresh(corpus(spark, ["abcdefgh", "ijklmnop"]))
    assert stored == spark.table(index.variants).count()


def test_stored_side_isnt_shuffled(spark, tmp_path):
    index = NameIndex(spark, f"file://{tmp_path}/index", 4)
    index.refresh(corpus(spark, words(3, 50)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.within(spark.range(50).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("abcab"), F.col("id")).alias("norm")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and index.variants in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    above, least = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < least:
            least = depth(x)
            above.append(x)
    upto = next(i for i, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[:upto]) and "Bucketed: true" in lines[at]
