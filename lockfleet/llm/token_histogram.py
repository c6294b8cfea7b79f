"""Exact token counts from a histogram of encoded lengths.

Documents are aggregated by encoded length first; everything asked about totals, quantiles and
context limits is answered from that histogram with prefix and suffix sums. The sums run in two levels
(lengths within buckets of ``SPAN``, then buckets), so no task holds the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.llm.bpe import token_counts
from lockfleet.llm.scratch import written

#: Lengths in a bucket of the two-level sums.
SPAN = 1024


def histogram(docs: DataFrame, path: str) -> DataFrame:
    """``(n_tokens, n_docs)``: how many rows of ``docs`` encode to each length. Null texts have length 0."""
    return token_counts(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_table(hist: DataFrame) -> DataFrame:
    """For each length in the histogram, taken as a context limit, what a corpus cut there holds.

    ``n_tokens`` (the limit), ``n_docs`` of exactly that length, ``docs_within`` of that length or less,
    ``docs_longer``, ``tokens_within`` in the former, ``truncated_total`` = sum of
    min(length, limit) over all documents, ``total_tokens``, and ``quantile`` = docs_within / all.
    Limits between two lengths lie on the line between their rows (see :func:`truncated_at`).
    An empty histogram gives no rows.
    """
    rows = hist.withColumn("bucket", F.expr(f"n_tokens div {SPAN}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select("bucket", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("total_tokens"))
    upto = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(sums, "bucket").withColumn("docs_within", F.col("d0") + F.sum("n_docs").over(upto)).withColumn("tokens_within", F.col("t0") + F.sum("tokens").over(upto))
    longer = F.col("all_docs") - F.col("docs_within")
    return rows.select("n_tokens", "n_docs", "docs_within", longer.alias("docs_longer"), "tokens_within", (F.col("tokens_within") + F.col("n_tokens") * longer).alias("truncated_total"), "total_tokens", (F.col("docs_within") / F.col("all_docs")).alias("quantile"))


def truncated_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, truncated_total, docs_longer)`` for a stated list of limits; both are 0 if the histogram is empty."""
    cols = [F.struct(F.lit(k).cast("long").alias("context_limit"), F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(k)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"), F.coalesce(F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs")).otherwise(0)), F.lit(0)).alias("docs_longer")) for k in limits]
    return hist.agg(F.array(*cols).alias("x")).select(F.inline("x"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the least length with at least that share of documents within it; null if the histogram is empty."""
    t = context_table(hist)
    cols = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return t.agg(F.array(*cols).alias("x")).select(F.inline("x"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """:func:`context_table` of ``docs``; the documents are encoded once."""
    return context_table(written(histogram(docs, path), "lengths"))
