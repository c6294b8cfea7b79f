"""Similarity joins of names against a corpus of known names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.functions.distance import distance_within, maybe_within
from lockfleet.functions.text import budget, charmap, normalize


def unknown(packages: DataFrame, corpus: DataFrame) -> DataFrame:
    """Packages whose normalised name, added as ``norm``, the corpus doesn't hold."""
    rows = packages.withColumn("norm", normalize(F.col("name"), F.col("ecosystem")))
    return rows.join(corpus.select("ecosystem", F.col("name").alias("norm")).distinct(), ["ecosystem", "norm"], "left_anti")


def deletions(name, most: int):
    """A name and all it becomes by leaving out up to ``most`` (1 or 2) of its characters."""
    chars = F.sequence(F.lit(1), F.length(name))
    cut = lambda s, i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s)))
    one = F.when(F.length(name) > 0, F.transform(chars, lambda i: cut(name, i))).otherwise(F.array().cast("array<string>"))
    out = F.concat(F.array(name), one)
    if most > 1:
        two = F.flatten(F.transform(one, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: cut(s, i))).otherwise(F.array().cast("array<string>"))))
        out = F.concat(out, two)
    return F.array_distinct(out)


def within(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(ecosystem, norm, candidate, distance)``: corpus names within each name's budget.

    Two names within k edits share a string that either becomes by k deletions at most (a
    transposition is one deletion on either side), so both sides are exploded into deletion
    neighbourhoods and met by an equi-join, which shuffles and has no hot band as a join on lengths
    has. The survivors of native filters are measured exactly.
    """
    mine = names.withColumn("k", budget(F.col("norm"))).where("k > 0")
    left = mine.select("ecosystem", "norm", "k", charmap(F.col("norm")).alias("ma"), F.explode(F.when(F.col("k") == 1, deletions(F.col("norm"), 1)).otherwise(deletions(F.col("norm"), 2))).alias("part"))
    known = corpus.select("ecosystem", F.col("name").alias("candidate")).distinct()
    # only names of a length that some budget reaches, and only as many deletions as the longest asks for
    right = known.where(F.length("candidate") >= 4).select("ecosystem", "candidate", charmap(F.col("candidate")).alias("mb"), F.explode(F.when(F.length("candidate") >= 8, deletions(F.col("candidate"), 2)).otherwise(deletions(F.col("candidate"), 1))).alias("part"))
    met = left.join(right, ["ecosystem", "part"]).where(maybe_within(F.col("norm"), F.col("candidate"), F.col("k"), F.col("ma"), F.col("mb")))
    met = met.select("ecosystem", "norm", "candidate", "k").distinct()
    return met.withColumn("distance", distance_within(F.col("norm"), F.col("candidate"), F.col("k"))).where("distance is not null").drop("k")


def close(names: DataFrame, corpus: DataFrame, most: int = 2) -> DataFrame:
    """``(ecosystem, norm, candidate, distance)``: corpus names within ``most`` (1 or 2) edits of ``names(ecosystem, norm)``, however short they are."""
    left = names.select("ecosystem", "norm", F.explode(deletions(F.col("norm"), most)).alias("part"))
    known = corpus.select("ecosystem", F.col("name").alias("candidate")).distinct()
    right = known.select("ecosystem", "candidate", F.explode(deletions(F.col("candidate"), most)).alias("part"))
    met = left.join(right, ["ecosystem", "part"]).where(maybe_within(F.col("norm"), F.col("candidate"), F.lit(most))).select("ecosystem", "norm", "candidate").distinct()
    return met.withColumn("distance", distance_within(F.col("norm"), F.col("candidate"), F.lit(most))).where("distance is not null")


def best(pairs: DataFrame) -> DataFrame:
    """``(ecosystem, norm, nearest, distance)``: of rows of :func:`within` the nearest; ties go to fewer bytes, then byte order."""
    least = F.min(F.struct("distance", F.octet_length("candidate").alias("size"), "candidate")).alias("x")
    return pairs.groupBy("ecosystem", "norm").agg(least).select("ecosystem", "norm", F.col("x.candidate").alias("nearest"), F.col("x.distance").alias("distance"))


def nearest(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(ecosystem, norm, nearest, distance)``: the nearest known name in budget, see :func:`best`."""
    return best(within(names, corpus))


def near_names(packages: DataFrame, query: str, most: int = 2, top: int = 8) -> DataFrame:
    """``(distance, name, source)``: package names within ``most`` edits of a query, the first ``top``. ``packages`` has ``ecosystem``."""
    rows = packages.withColumn("norm", normalize(F.col("name"), F.col("ecosystem"))).withColumn("want", normalize(F.lit(query), F.col("ecosystem")))
    rows = rows.where(maybe_within(F.col("want"), F.col("norm"), F.lit(most))).select("name", "source", "norm", "want").distinct()
    rows = rows.withColumn("distance", distance_within(F.col("want"), F.col("norm"), F.lit(most))).where("distance is not null")
    return rows.select("distance", "name", "source").distinct().orderBy("distance", "name", "source").limit(top)


def ranked_near(rows: DataFrame, top: int = 8) -> DataFrame:
    """Numbers rows of :func:`near_names` in their order."""
    return rows.withColumn("rn", F.row_number().over(Window.orderBy("distance", "name", "source")))
