"""Snapshot diffs: identities, versions and findings of two trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.operators.rules import third_party

NOTHING = "—"


def identities(packages: DataFrame) -> DataFrame:
    return third_party(packages).select(F.concat("name", F.lit("@"), "version").alias("identity")).distinct()


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Identities of ``new`` that ``old`` hasn't; the other way round it is what was removed."""
    return identities(new).join(identities(old), "identity", "left_anti")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(name, from, to)``: of names in both, versions that went and that came, paired in byte order."""
    a = third_party(old).select("name", "version").distinct()
    b = third_party(new).select("name", "version").distinct()
    both = a.select("name").distinct().join(b.select("name").distinct(), "name", "left_semi")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("version"))
    gone = a.join(b, ["name", "version"], "left_anti").join(both, "name", "left_semi").select("name", nth.alias("n"), F.col("version").alias("from"))
    came = b.join(a, ["name", "version"], "left_anti").join(both, "name", "left_semi").select("name", nth.alias("n"), F.col("version").alias("to"))
    return gone.join(came, ["name", "n"], "full").select("name", F.coalesce("from", F.lit(NOTHING)).alias("from"), F.coalesce("to", F.lit(NOTHING)).alias("to"))


def introduced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of ``new`` whose rule and package ``old`` hasn't; versions don't matter. Swap them for what was resolved."""
    return new.join(old.select("rule", "package").distinct(), ["rule", "package"], "left_anti").select(new.columns)
