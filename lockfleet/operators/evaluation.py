"""Evaluation: thinned corpora, precision and recall, budget policies, leave-one-out neighbours."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.operators.similarity import close
from lockfleet.storage import written

BITS = 64


def _step(s: np.ndarray) -> np.ndarray:
    """One step of the 64-bit xorshift sequence (13, 7, 17)."""
    s = s ^ (s << np.uint64(13))
    s = s ^ (s >> np.uint64(7))
    return s ^ (s << np.uint64(17))


@cache
def _leaps() -> list[np.ndarray]:
    """For k = 0, 1, …: what 2**k steps make of each value of each byte of a state (8 rows of 256).

    A step is linear over bits: it makes of a state the sum (xor) of what it makes of the state's bits. So any number of steps
    is a 64 by 64 matrix of bits, kept as tables by byte, and twice the steps are the same matrix applied twice.
    """
    values = np.arange(256, dtype=np.uint64)
    tables = [np.stack([_step(values << np.uint64(8 * b)) for b in range(8)])]
    for _ in range(BITS - 2):
        tables.append(np.stack([_leapt(row, tables[-1]) for row in tables[-1]]))
    return tables


def _leapt(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for b in range(8):
        out ^= table[b][(states >> np.uint64(8 * b)) & np.uint64(255)]
    return out


def states(places: np.ndarray, seed: int) -> np.ndarray:
    """The sequence's states after each of ``places`` steps, in any order, each by a leap for each bit of its place."""
    out = np.full(len(places), seed | 1, np.uint64)
    for k, table in enumerate(_leaps()):
        far = (places >> k) & 1 == 1
        if far.any():
            out[far] = _leapt(out[far], table)
        if not (places >> (k + 1)).any():
            break
    return out


def placed(names: DataFrame) -> DataFrame:
    """``(name, place)``: the rows of ``names(name)`` numbered from 1 in the order of their bytes.

    Ranges of names are counted first; a range's names are numbered where they are, from what the ranges before hold.
    """
    spark = names.sparkSession
    ranged = written(names.select("name").repartitionByRange("name").select("name", F.spark_partition_id().alias("range")), "ranges")
    counts = sorted(ranged.groupBy("range").count().collect())  # a row a range
    before = spark.createDataFrame([(r["range"], sum(x["count"] for x in counts[:i])) for i, r in enumerate(counts)], "range int, before long")
    number = F.row_number().over(Window.partitionBy("range").orderBy("name"))
    return ranged.join(F.broadcast(before), "range").select("name", (F.col("before") + number).alias("place"))


def drawn(names: DataFrame, seed: int) -> DataFrame:
    """``(name, draw)``: for each row of ``names(name)`` in the order of bytes the next number, below 1000, of a sequence that begins with ``seed``.

    The same as drawing one after the other, however the names are partitioned.
    """

    @F.pandas_udf("int")
    def draw(place: pd.Series) -> pd.Series:
        return pd.Series((states(place.to_numpy(np.int64), seed) % np.uint64(1000)).astype(np.int32))

    return placed(names).select("name", draw("place").alias("draw"))


def thinned(names: DataFrame, permille: int, seed: int) -> DataFrame:
    """The rows of ``names(name)`` whose draw is below ``permille``."""
    return drawn(names, seed).where(F.col("draw") < permille).select("name")


def ratio(part: Column, whole: Column) -> Column:
    """A share, 1 where there is nothing to share."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def confusion(judged: DataFrame, *keys: str) -> DataFrame:
    """``(keys, tp, fp, fn, precision, recall)`` of ``judged(keys, planted, found)``."""
    out = judged.groupBy(*keys).agg(F.count_if(F.col("planted") & F.col("found")).alias("tp"), F.count_if(~F.col("planted") & F.col("found")).alias("fp"), F.count_if(F.col("planted") & ~F.col("found")).alias("fn"))
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def neighbours(corpus: DataFrame) -> DataFrame:
    """``(ecosystem, size, names, near1, near2)``: by length, how many names have another within 1 or 2 edits.

    The budgets are flat: what a scan would allow a name of that length is what these rates are to tell.
    """
    names = corpus.select("ecosystem", F.col("name").alias("norm")).distinct()
    near = close(names, corpus).where("norm <> candidate").groupBy("ecosystem", "norm").agg(F.min("distance").alias("d"))
    rows = names.join(near, ["ecosystem", "norm"], "left")
    return rows.groupBy("ecosystem", F.length("norm").alias("size")).agg(F.count("*").alias("names"), F.count_if(F.col("d") <= 1).alias("near1"), F.count_if(F.col("d") <= 2).alias("near2"))
