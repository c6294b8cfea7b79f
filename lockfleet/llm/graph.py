"""Connected components and joins that stand hot keys, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.scratch import drop, written

#: A key is hot if it has more than one row in so many. At most this many keys can be hot, whatever
#: the input's size, so a table of one row for each is small enough to broadcast.
HOT_SHARE = 512


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", rows: str | None = None, total: int | None = None) -> DataFrame:
    """Joins ``big`` to ``small``, which has one row for each key, where a key may hold a third of ``big``.

    The keys with over 1/512 of the rows (511 at most) are joined by broadcast, where their rows
    stand; all others by shuffle. ``how`` is "left" or "inner". Null keys match nothing; under
    "left" they stay. Both sides must be cheap to read twice (written tables). ``rows`` names a column
    of ``small`` that already holds how many rows of ``big`` each key has, and ``total`` how many there are; they spare the counts.
    """
    if rows:
        counts, small = small.select(key, F.col(rows).alias("__n")), small.drop(rows)
    else:
        counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = big.count() if total is None else total
    hot = [r[0] for r in counts.where(F.col("__n") * HOT_SHARE > total).select(key).collect()] if total > 10 * HOT_SHARE else []
    if not hot:
        return big.join(small, key, how)
    is_hot = F.col(key).isin(hot)
    few = F.broadcast(small.where(is_hot))
    rest = big.where(~F.coalesce(is_hot, F.lit(False)))
    return big.where(is_hot).join(few, key, how).unionByName(rest.join(small.where(~is_hot), key, how))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)``, root being the component's least node.

    Alternating large-star and small-star steps: each round joins neighbours to the least
    neighbour, until nothing changes; the rounds grow with the logarithm of the longest chain. Each
    round is one written table, so a lost executor repeats one round at most. Loops, repeated and
    null edges are dropped; without edges the result is empty. Nodes without an edge aren't in it. The centre of a
    star may have most of the edges: its rows are joined where they stand (:func:`skew_join`).
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state, size = None, now.count()
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = skew_join(both, least, "u", "inner", "n", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = skew_join(large, least, "u", "inner", "n", 2 * size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(large)
        drop(now)
        now, size = new, seen[0]
        if seen == state or not seen[0]:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        state = seen
