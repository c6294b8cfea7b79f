"""What changed in each lockfile each time it lands: the diff of two trees as a stream with state.

``landing.audits`` writes what stands in each file that lands. This query follows those rows, holds the last state of each
lockfile, and tells what is new and what is gone against it. A state that comes again changes nothing, so a batch that
is replayed tells nothing twice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lockfleet.operators.diff import NOTHING
from lockfleet.operators.rules import third_party

#: What stands in a file: a row for the file itself, for each third-party identity, and for each finding.
ITEMS = "landed long, source string, kind string, rule string, package string, version string, severity string, detail string"
CHANGES = "landed long, landing string, source string, section string, rule string, package string, version string, severity string, detail string, was string"
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def standing(lockfiles: DataFrame, packages: DataFrame, findings: DataFrame, landed: int) -> DataFrame:
    """Rows of ITEMS for files that landed together."""
    none = [F.lit(None).cast("string").alias(c) for c in ("rule", "package", "version", "severity", "detail")]
    files = lockfiles.select("source", F.lit("file").alias("kind"), *none)
    names = third_party(packages).select("source", F.lit("package").alias("kind"), none[0], F.col("name").alias("package"), "version", *none[3:]).distinct()
    found = findings.select("source", F.lit("finding").alias("kind"), "rule", "package", "version", "severity", "detail")
    return files.unionByName(names).unionByName(found).select(F.lit(landed).cast("long").alias("landed"), "*")


def compared(old: set[tuple], new: set[tuple]) -> Iterator[tuple]:
    """``(section, rule, package, version, severity, detail, was)`` from sets of ``(kind, rule, package, version, severity, detail)``.

    Identities are added or removed; of names in both, versions that went and came are paired in byte order; findings are
    introduced or resolved by rule and package, whatever their version.
    """
    held = [defaultdict(set), defaultdict(set)]
    for side, rows in zip(held, (old, new)):
        for kind, _, package, version, *_ in rows:
            if kind == "package":
                side[package].add(version)
    for name in sorted(held[0].keys() | held[1].keys()):
        gone, came = (sorted(held[i][name] - held[1 - i][name], key=str.encode) for i in (0, 1))
        yield from (("removed", None, name, v, None, None, None) for v in gone)
        yield from (("added", None, name, v, None, None, None) for v in came)
        if held[0][name] and held[1][name]:
            yield from (("changed", None, name, b, None, None, a) for a, b in zip_longest(gone, came, fillvalue=NOTHING))
    pairs = [{(r[1], r[2]) for r in rows if r[0] == "finding"} for rows in (old, new)]
    for section, rows, other in (("introduced", new, pairs[0]), ("resolved", old, pairs[1])):
        yield from ((section, *r[1:], None) for r in sorted(rows, key=str) if r[0] == "finding" and (r[1], r[2]) not in other)


class LastState(StatefulProcessor):
    """Holds what stood in a lockfile when it landed last. A group is one lockfile's rows in a batch, and its state is as large as the file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "kind string, rule string, package string, version string, severity string, detail string", "there boolean")
        self.first = handle.getValueState("landed", "landed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        landed: dict[tuple, set] = defaultdict(set)
        for part in rows:
            for r in part.astype(object).where(part.notna(), None).itertuples(index=False):
                landed[int(r.landed), r.landing].add((r.kind, r.rule, r.package, r.version, r.severity, r.detail))
        known = self.first.exists()
        old = {tuple(k) for k, _ in self.held.iterator()} if known else set()
        began, out = set(old), []
        for at in sorted(landed):
            new = landed[at]
            if known:
                out += [(*at, key[0], *x) for x in compared(old, new)]
            old, known = new, True
        for k in began - old:
            self.held.removeKey(k)
        for k in old - began:
            self.held.updateValue(k, (True,))
        self.first.update((max(landed)[0],))
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"landed": "int64"})


def changes(spark: SparkSession, audited: str, out: str, checkpoint: str, folders: int = 1, once: bool = False, files: int = 1000) -> StreamingQuery:
    """Writes rows of CHANGES under ``out`` as ``landing.audits`` goes on writing under ``audited``.

    A lockfile is known by its path below the first ``folders`` folders of the landing folder, which name a landing:
    ``day1/app/go.mod`` and ``day2/app/go.mod`` are one. Landings of one batch come in the byte order of their names. Its first landing changes nothing. A file that can't be
    read (or is empty, which Spark's reader doesn't tell) has no state of its own: the next that can is compared with the last that could.
    """
    rows = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{audited}/standing")
    path = F.split("source", "/")
    rows = rows.withColumn("landing", F.array_join(F.slice(path, 1, folders), "/")).withColumn("source", F.array_join(F.slice(path, folders + 1, 1_000_000), "/"))
    told = rows.groupBy("source").transformWithStateInPandas(LastState(), outputStructType=CHANGES, outputMode="Append", timeMode="None")
    writer = told.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)  # a query takes the session's settings along as it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(_STORE[0], before)
