"""Scalar functions on names and versions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would fold other letters too."""
    return F.translate(c, _UPPER, _LOWER)


def normalize(name: Column, ecosystem: Column | str) -> Column:
    """A name as the corpus spells it: lower-cased, and on PyPI runs of ``-_.`` as one dash."""
    eco = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
    low = ascii_lower(name)
    return F.when(eco == "pypi", F.regexp_replace(low, "[-_.]+", "-")).otherwise(low)


def scrub(c: Column) -> Column:
    """Control characters become U+FFFD."""
    return F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", "�")


def label(name: Column, version: Column) -> Column:
    return F.when(version == "", name).otherwise(F.concat(name, F.lit("@"), version))


def budget(name: Column, most: int = 2, per: int = 5) -> Column:
    """The edit distance that is allowed a name: one for each ``per`` characters, ``most`` at most."""
    return F.least(F.lit(most), F.floor(F.length(name) / per)).cast("int")


def charmap(name: Column) -> Column:
    """A 64-bit set of a name's characters, by code point modulo 64."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % 64).cast("int"))))


def pad(c: Column, width: Column | int) -> Column:
    """Pads on the right and never cuts (rpad does)."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), w - F.length(c))))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def severity_rank(c: Column) -> Column:
    """1 to 4 for low to critical in any case; null for anything else."""
    low = ascii_lower(c)
    return F.when(low == "low", 1).when(low == "medium", 2).when(low == "high", 3).when(low == "critical", 4)


# Semantic versions -------------------------------------------------------------------------

_NUMBER = "^[0-9]{1,20}$"


def semver(version: Column) -> Column:
    """A sort key of a version; null if it is none.

    One to three numeric components (missing ones are 0), after an optional v and without build
    metadata. Releases sort after their prereleases; prerelease identifiers by number, numbers
    before words, a shorter list first. Arrays and structs compare in just this way.
    """
    bare = F.regexp_replace(F.trim(version), "^v", "")
    bare = F.substring_index(bare, "+", 1)
    core = F.substring_index(bare, "-", 1)
    pre = F.when(F.instr(bare, "-") > 0, F.substring(bare, F.instr(bare, "-") + 1, F.length(bare)))
    parts = F.split(core, "\\.")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    ok = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike(_NUMBER) & (p.try_cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)")))
    ident = lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), 0).otherwise(1).alias("word"), F.when(p.rlike(_NUMBER), p.try_cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)")).alias("number"), p.alias("text"))
    none = F.lit(None).cast("array<struct<word:int,number:decimal(20,0),text:string>>")
    key = F.struct(at(0).alias("major"), at(1).alias("minor"), at(2).alias("patch"), F.when(pre.isNull(), 1).otherwise(0).alias("release"), F.when(pre.isNotNull(), F.transform(F.split(pre, "\\."), ident)).otherwise(none).alias("pre"))
    return F.when(ok, key)


def version_order(version: Column) -> Column:
    """A sort key of any version: semantic versions first, then the others by their bytes."""
    key = semver(version)
    return F.struct(F.when(key.isNull(), 1).otherwise(0).alias("other"), key.alias("key"), version.alias("raw"))


# Requirement specifiers --------------------------------------------------------------------

_VERSION = "[A-Za-z0-9.*+!_-]+"
_CLAUSE = f"^(===|==|~=|!=|<=|>=|<|>){_VERSION}$"


def pin(spec: Column) -> Column:
    """``struct<kind, spec, version>`` of a specifier without blanks; null if it isn't understood.

    The tightest clause decides: exact, then capped (``~=``, or an exact one with a star), then open, then
    exclusions alone, which leave it unconstrained. The last exact clause gives the version.
    """
    clauses = F.split(spec, ",")
    exact = lambda c: c.startswith("==") & ~c.contains("*")
    rank = F.array_min(F.transform(clauses, lambda c: F.when(exact(c), 0).when(c.startswith("==") | c.startswith("~="), 1).when(c.startswith("!="), 3).otherwise(2)))
    version = F.regexp_replace(F.element_at(F.filter(clauses, exact), -1), "^={2,3}", "")
    free = (spec == "") | spec.startswith("@")
    kind = F.when(free | (rank == 3), "unconstrained").when(rank == 0, "exact").when(rank == 1, "compatible").otherwise("range")
    held = F.when(~free & rank.isin(1, 2), spec)
    made = F.struct(kind.alias("kind"), held.alias("spec"), F.when(~free & (rank == 0), version).otherwise(F.lit("")).alias("version"))
    return F.when(free | F.forall(clauses, lambda c: c.rlike(_CLAUSE)), made)
