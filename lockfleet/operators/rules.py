"""The five rules, each a DataFrame of findings, and their union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockfleet import schema
from lockfleet.functions.text import version_order
from lockfleet.operators.graph import in_degree, out_degree
from lockfleet.operators.similarity import nearest, unknown

# The wording of the findings.
SCRIPT = "runs code at install time · lockfile records the flag, not the script"
MICRO = "one expression, one publisher · inlining it removes an account from your build"
SHAPED = "predicate-shaped, resolves nothing · size not measured, see rule docs"
UNBOUND = "no bound in either direction · resolves to whatever is newest at install time"
RANGE = " · a range, so the file does not say what installs"
CAPPED = " · capped at the major, still floats below the cap"

# Packages of one expression.
KNOWN = [
    "array-flatten", "code-point-at", "es-errors", "gopd", "has-flag", "hasown", "inherits", "is-arrayish", "is-buffer", "is-even",
    "is-extendable", "is-negative-zero", "is-npm", "is-number", "is-obj", "is-odd", "is-plain-obj", "is-windows", "isarray", "isobject",
    "left-pad", "number-is-nan", "object-assign", "pad-left",
]


def _finding(rule: str, severity: Column | str, package: str | Column, version: Column, detail: Column) -> list[Column]:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    rank = F.array_position(F.array(*map(F.lit, schema.SEVERITIES)), sev).cast("int")
    name = F.col(package) if isinstance(package, str) else package
    return [F.col("source"), F.lit(rule).alias("rule"), F.lit(schema.RULES.index(rule)).alias("rule_rank"), sev.alias("severity"), rank.alias("sev_rank"), name.alias("package"), version.alias("version"), detail.alias("detail")]


def third_party(packages: DataFrame) -> DataFrame:
    return packages.where(~F.col("first_party"))


def slopsquat(lockfiles: DataFrame, packages: DataFrame, edges: DataFrame, corpus: DataFrame, require_no_parent: bool = True, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Registry names that the corpus doesn't know, without parents, near a name that it knows; ``near`` finds the nearest of names (by default a join with the corpus)."""
    covered = corpus.select("ecosystem").distinct()
    mine = third_party(packages).where("origin = 'registry'").join(lockfiles.select("source", "ecosystem", "records_edges"), "source").join(covered, "ecosystem", "left_semi")
    mine = unknown(mine, corpus)
    degree = in_degree(edges)
    mine = mine.join(degree, ["source", "idx"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    if require_no_parent:
        mine = mine.where("in_degree = 0")
    names = mine.select("ecosystem", "norm").distinct()
    found = near(names) if near else nearest(names, corpus)
    parent = F.when(~F.col("records_edges"), "no dependency graph in this format").when(F.col("in_degree") == 0, "root-only, no parent").otherwise(F.concat(F.col("in_degree").cast("string"), F.lit(" parent(s)")))
    detail = F.concat(F.lit("not in corpus · d="), F.col("distance").cast("string"), F.lit(' from "'), F.col("nearest"), F.lit('" · '), parent)
    return mine.join(found, ["ecosystem", "norm"]).select(*_finding("slopsquat", "critical", "name", F.col("version"), detail))


def install_scripts(packages: DataFrame) -> DataFrame:
    return third_party(packages).where("install_script").select(*_finding("install-script", "high", "name", F.col("version"), F.lit(SCRIPT)))


def trivial(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """Known one-expression packages, and predicate-shaped names that depend on nothing; once for each name and version."""
    bare = F.substring_index("name", "/", -1)
    rows = third_party(packages).where(bare.isin(*KNOWN) | bare.startswith("is-") | bare.startswith("has-"))
    rows = rows.join(out_degree(edges), ["source", "idx"], "left")
    known = bare.isin(*KNOWN)
    rows = rows.where(known | F.col("out_degree").isNull())
    once = rows.groupBy("source", "name", "version").agg(F.min_by(F.when(known, F.lit(MICRO)).otherwise(F.lit(SHAPED)), "idx").alias("detail"))
    return once.select(*_finding("trivial", "low", "name", F.col("version"), F.col("detail")))


def drift(packages: DataFrame) -> DataFrame:
    """Names with two or more versions in one file, versions in their order."""
    groups = third_party(packages).groupBy("source", "name").agg(F.collect_set("version").alias("v")).where(F.size("v") > 1)
    ordered = F.transform(F.array_sort(F.transform("v", version_order)), lambda x: x["raw"])
    detail = F.concat(F.size("v").cast("string"), F.lit(" versions: "), F.array_join(ordered, ", "))
    return groups.select(*_finding("drift", "medium", "name", F.lit(""), detail))


def pinning(lockfiles: DataFrame, packages: DataFrame) -> DataFrame:
    """PyPI requirements that leave the version open, as far as they do."""
    pypi = lockfiles.where("ecosystem = 'pypi'").select("source")
    kind = F.col("pin_kind")
    severity = F.when(kind == "unconstrained", "high").when(kind == "range", "medium").otherwise("low")
    detail = F.when(kind == "unconstrained", F.lit(UNBOUND)).when(kind == "range", F.concat("pin_spec", F.lit(RANGE))).otherwise(F.concat("pin_spec", F.lit(CAPPED)))
    return packages.where(kind != "exact").join(pypi, "source", "left_semi").select(*_finding("pinning", severity, "name", F.col("version"), detail))


def audit(lockfiles: DataFrame, packages: DataFrame, edges: DataFrame, corpus: DataFrame, require_no_parent: bool = True, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All findings; order them by source, rule_rank, package, version."""
    out = slopsquat(lockfiles, packages, edges, corpus, require_no_parent, near)
    for more in (install_scripts(packages), trivial(packages, edges), drift(packages), pinning(lockfiles, packages)):
        out = out.unionByName(more)
    return out


def not_applicable(lockfiles: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(source, rule, rule_rank)`` of rules that can't fire on a file."""
    covered = corpus.select("ecosystem").distinct().withColumn("covered", F.lit(True))
    rows = lockfiles.join(covered, "ecosystem", "left")
    silent = F.array(F.when(F.col("covered").isNull(), 0), F.when(~F.col("records_install_scripts"), 1), F.when(F.col("format") != "pip", 4))
    rank = rows.select("source", F.explode(F.array_compact(silent)).alias("rule_rank"))
    return rank.select("source", F.get(F.array(*map(F.lit, schema.RULES)), "rule_rank").alias("rule"), "rule_rank")
