"""Lockfiles that land in a folder, read as a stream and audited batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lockfleet import schema
from lockfleet.operators import rules
from lockfleet.sources.lockfiles import entered, read, roots, source_of
from lockfleet.storage import drop, written
from lockfleet.streaming.changes import standing


def audits(spark: SparkSession, landing: str, out: str, checkpoint: str, corpus: DataFrame, once: bool = False) -> StreamingQuery:
    """Writes findings, errors and what stands in each new file under ``out``; a batch that runs again replaces its own rows.

    Files are independent of one another, so batches need no state; the checkpoint knows which files are done. Folders that
    discovery doesn't enter (see ``lockfiles.discover``) aren't read here either.
    """
    tops = sorted({r.path.rstrip("/") for r in roots(spark, landing)}, key=lambda x: -len(x))
    globs = "{" + ",".join("*" + f[0] for f in schema.FORMATS) + "}"
    rows = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", globs).text(landing)
    rows = rows.select(source_of(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("text"))
    rows = rows.where(entered(F.col("source"), tops))
    below = F.coalesce(*[F.when(F.col("source").startswith(x + "/"), F.substr("source", F.lit(len(x) + 2))) for x in tops], F.col("source"))

    def batch(df: DataFrame, epoch: int) -> None:
        t = read(df.persist())
        findings = written(rules.audit(t.lockfiles, t.packages, t.edges, corpus), "findings")
        findings.write.mode("overwrite").parquet(f"{out}/findings/epoch={epoch}")
        standing(t.lockfiles, t.packages, findings, epoch).withColumn("source", below).write.mode("overwrite").parquet(f"{out}/standing/epoch={epoch}")
        drop(findings)
        t.errors.write.mode("overwrite").parquet(f"{out}/errors/epoch={epoch}")
        t.release()
        df.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
