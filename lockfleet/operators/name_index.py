"""Known names kept as a bucketed table of their deletion variants, for similarity joins that don't shuffle them.

``similarity.within`` spells out the variants of the whole corpus at each run. Here they are stored once, bucketed by what the
join asks for, and a refresh adds only what names are new. Names that are gone stay in the variants, and a log of names says
which of them are known now: only what is near by distance meets it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockfleet.functions.distance import distance_within, maybe_within
from lockfleet.functions.text import budget, charmap
from lockfleet.operators.similarity import best, deletions

_VARIANTS = "key string, candidate string, mb long"
_NAMES = "key string, ecosystem string, name string, generation int, known boolean"


def _key(name: str):
    """What both tables are bucketed by: one column, as a join on two loses a key that happens to be constant, and the buckets with it."""
    return F.concat(F.col("ecosystem"), F.lit("\t"), F.col(name))


class NameIndex:
    """An index of known names in a folder that all executors share; made there if there is none.

    ``buckets`` is a property of the stored table: give the same number whenever the folder is opened. One writer
    at a time. A refresh that is lost between its two writes is whole after the next: variants that are stored
    twice change no result.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        key = hashlib.md5(f"{self.path}#{buckets}".encode()).hexdigest()[:16]
        self.variants, self.log = f"known_variants_{key}", f"known_names_{key}"
        for table, columns in ((self.variants, _VARIANTS), (self.log, _NAMES)):
            folder = f"{self.path}/{table.rsplit('_', 1)[0]}"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def _latest(self) -> DataFrame:
        return self.spark.table(self.log).groupBy("key", "ecosystem", "name").agg(F.max("generation").alias("generation"), F.max_by("known", "generation").alias("known"))

    def names(self) -> DataFrame:
        """``(ecosystem, name)``: the names that are known now."""
        return self._latest().where("known").select("ecosystem", "name")

    def refresh(self, corpus: DataFrame) -> None:
        """Makes the index that of ``corpus(ecosystem, name)``: writes what differs from what is stored, and nothing else. Nulls are no names."""
        new = corpus.select("ecosystem", "name").na.drop().distinct().withColumn("now", F.lit(True))
        both = self._latest().drop("ecosystem", "name").join(new.withColumn("key", _key("name")), "key", "full")
        now, known = F.coalesce("now", F.lit(False)), F.coalesce("known", F.lit(False))
        parted = F.split("key", "\t", 2)
        differs = both.where(now != known).select("key", parted[0].alias("ecosystem"), parted[1].alias("name"), "generation", now.alias("known"))
        fresh = differs.where("generation is null").select("ecosystem", F.col("name").alias("candidate"))
        parts = F.when(F.length("candidate") >= 8, deletions(F.col("candidate"), 2)).otherwise(deletions(F.col("candidate"), 1))
        rows = fresh.where(F.length("candidate") >= 4).select("ecosystem", F.explode(parts).alias("part"), "candidate", charmap(F.col("candidate")).alias("mb"))
        rows = rows.select(_key("part").alias("key"), "candidate", "mb")
        self._append(rows, self.variants)
        self._append(differs.select("key", "ecosystem", "name", (F.coalesce("generation", F.lit(-1)) + 1).cast("int").alias("generation"), "known"), self.log)

    def _append(self, rows: DataFrame, table: str) -> None:
        # dealt as the buckets are, so that a refresh adds a file to each bucket and not one from each task
        rows.repartition(self.buckets, "key").write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def within(self, names: DataFrame) -> DataFrame:
        """``(ecosystem, norm, candidate, distance)``: as ``similarity.within(names, corpus)``, the stored side read bucket by bucket."""
        mine = names.withColumn("k", budget(F.col("norm"))).where("k > 0")
        parts = F.when(F.col("k") == 1, deletions(F.col("norm"), 1)).otherwise(deletions(F.col("norm"), 2))
        left = mine.select("ecosystem", "norm", "k", charmap(F.col("norm")).alias("ma"), F.explode(parts).alias("part")).withColumn("key", _key("part"))
        met = left.join(self.spark.table(self.variants), "key").where(maybe_within(F.col("norm"), F.col("candidate"), F.col("k"), F.col("ma"), F.col("mb")))
        met = met.select("ecosystem", "norm", "candidate", "k").distinct()
        met = met.withColumn("distance", distance_within(F.col("norm"), F.col("candidate"), F.col("k"))).where("distance is not null")
        known = self._latest().where("known").select("key")
        return met.withColumn("key", _key("candidate")).join(known, "key", "left_semi").select("ecosystem", "norm", "candidate", "distance")

    def nearest(self, names: DataFrame) -> DataFrame:
        """``(ecosystem, norm, nearest, distance)``: as ``similarity.nearest(names, corpus)``."""
        return best(self.within(names))
