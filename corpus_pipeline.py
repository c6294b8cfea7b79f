"""A training-corpus pipeline of five operators, each stage on all that its predecessor kept.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the runner writes it as Parquet and
reads it again as the next stage's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockfleet.llm import bpe, decontaminate, quality, simhash, substring_dedup
from lockfleet.llm.arrow import fresh
from lockfleet.llm.queries import _ranks_path, table
from lockfleet.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: of least doc_id (rows without any come last), then of least fingerprint.

    Rows that share a doc_id but not a component are told apart by their fingerprints, so each component keeps its own. Null
    texts are one component with blank ones; an empty table stays empty.
    """
    rows = written(simhash.groups(docs), "groups")
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint")).alias("k"))
    id_, print_ = (fresh(docs.columns, x) for x in ("keep_id", "keep_fingerprint"))
    keep = written(keep.select(F.col("k.doc_id").alias(id_), F.col("k.fingerprint").alias(print_)), "kept")
    mine = F.col("doc_id").cast("long")
    repeated = rows.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    if not keep.where(F.col(id_).isNull()).take(1) and not repeated.take(1):
        return docs.join(keep, mine == F.col(id_), "left_semi")
    marked, name = simhash.with_fingerprint(docs)
    kept = marked.join(keep, mine.eqNullSafe(F.col(id_)) & (F.col(f"`{name}`") == F.col(print_)), "left_semi")
    return kept.dropDuplicates(["doc_id", name]).select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs and passages that repeat across documents stay in the document of least doc_id only."""
    return substring_dedup.without_repeats(docs)


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document and decodes it again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe.digests(docs, _ranks_path())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_repeats),
    ("benchmark decontamination", benchmark_contamination),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL can express neither the learned rules nor the fingerprints; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
