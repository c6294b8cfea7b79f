"""Entity resolution: textual references become edges, by one join for each format's way of naming.

``entries(source, format, idx, name, version, key, first_party, src, direct, aliases, deps)``. References that
match nothing are dropped. Edges out of first-party entries are roots instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockfleet.functions.text import normalize

ORDER = ["source", "from_idx", "to_idx"]


def ancestors(path: Column, dep: Column) -> Column:
    """Keys at which an npm dependency may be installed, nearest first."""
    parts = F.split(path, "/node_modules/")
    n = F.size(parts)
    inner = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, n - i), "/node_modules/"), F.lit("/node_modules/"), dep))
    root = F.array(F.concat(F.lit("node_modules/"), dep))
    return F.when(path == "", root).otherwise(F.concat(inner, root))


def nearest_ancestor(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """As-of join by path prefix: ``refs(source, ref, path, dep)`` to the nearest of ``keys(source, key, idx)``."""
    tried = refs.select("source", "ref", F.posexplode(ancestors(F.col("path"), F.col("dep"))).alias("level", "key"), "dep")
    met = tried.join(keys, ["source", "key"])
    return met.groupBy("source", "ref", "dep").agg(F.min_by("idx", "level").alias("to_idx")).select("source", "ref", "to_idx")


def ranked(refs: DataFrame, names: DataFrame) -> DataFrame:
    """``refs(source, ref, nth, name, version, src)`` to one of ``names``: by source and version, by version, or the first if no version is asked.

    Each way of asking meets the first of the names that answer it, one row at most, so nothing grows with the names that are alike.
    """
    n = names.select("source", "name", "version", "src", "idx")
    met = refs.select("source", "ref", "name", "version", "src")
    for place, key in enumerate((["version", "src"], ["version"], [])):
        first = n.groupBy("source", "name", *key).agg(F.min("idx").alias(f"to_{place}"))
        met = met.join(first, ["source", "name", *key], "left")
    to = F.when(F.col("version").isNull(), F.col("to_2")).otherwise(F.coalesce("to_0", "to_1"))
    return met.select("source", "ref", to.alias("to_idx")).where("to_idx is not null")


def normalised(refs: DataFrame, names: DataFrame) -> DataFrame:
    """``refs(source, ref, nth, name, version)`` to every name that normalises alike; to the first of the asked version alone if there is one.

    The first of each version is found among the names, so pairs are made only where they are results, and no group is gathered.
    """
    n = names.select("source", normalize(F.col("name"), "pypi").alias("norm"), F.col("idx").alias("to_idx"), "version")
    one = n.groupBy("source", "norm", "version").agg(F.min("to_idx").alias("one"))
    asked = refs.select("source", "ref", normalize(F.col("name"), "pypi").alias("norm"), "version").join(one, ["source", "norm", "version"], "left")
    exact = asked.where("one is not null").select("source", "ref", F.col("one").alias("to_idx"))
    return exact.unionByName(asked.where("one is null").select("source", "norm", "ref").join(n.drop("version"), ["source", "norm"]).select("source", "ref", "to_idx"))


def aliased(refs: DataFrame, names: DataFrame) -> DataFrame:
    """``refs(source, ref, name)`` to the last entry that has the reference among its ``aliases``."""
    spec = names.select("source", "idx", F.explode("aliases").alias("name")).groupBy("source", "name").agg(F.max("idx").alias("to_idx"))
    return refs.join(spec, ["source", "name"]).select("source", "ref", "to_idx")


def without_parents(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries that no edge goes to."""
    return entries.select("source", "idx").join(edges.select("source", F.col("to_idx").alias("idx")).distinct(), ["source", "idx"], "left_anti")


def all_formats(files: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges(source, from_idx, to_idx)`` and ``roots(source, idx)``; first-party roots are the caller's to drop."""
    refs = entries.select("source", "format", "first_party", F.col("idx").alias("ref"), F.col("key").alias("path"), F.posexplode("deps").alias("nth", "d")).select("source", "format", "first_party", "ref", "path", "nth", "d.*")
    of = lambda *f: refs.where(F.col("format").isin(*f))
    own = lambda *f: entries.where(F.col("format").isin(*f))
    wanted = files.select("source", "format", F.explode("wanted").alias("name")).distinct()
    top = F.lit(-1).alias("ref")

    npm = of("npm").select("source", "ref", "path", F.col("name").alias("dep")).unionByName(wanted.where("format = 'npm'").select("source", top, F.lit("").alias("path"), F.col("name").alias("dep")))
    links = nearest_ancestor(npm, own("npm").select("source", "key", "idx")).distinct()
    by_alias = of("pnpm", "yarn").select("source", "ref", "name").unionByName(wanted.where("format = 'pnpm'").select("source", top, "name"))
    links = links.unionByName(aliased(by_alias, own("pnpm", "yarn")).distinct())
    links = links.unionByName(ranked(of("cargo"), own("cargo")))
    links = links.unionByName(normalised(of("poetry", "uv"), own("poetry", "uv")).where("ref <> to_idx"))

    first = entries.select("source", F.col("idx").alias("ref"), F.col("first_party").alias("ours"), "format")
    links = links.join(first, ["source", "ref"], "left")
    # pnpm and yarn have no manifests among their entries: their first-party entries keep their edges
    to_roots = (F.col("ref") == -1) | (F.col("ours") & F.col("format").isin("npm", "cargo", "poetry", "uv"))
    edges = links.where(~F.coalesce(to_roots, F.lit(False))).select("source", F.col("ref").alias("from_idx"), "to_idx")
    roots = links.where(to_roots).select("source", F.col("to_idx").alias("idx"))
    roots = roots.unionByName(without_parents(own("poetry", "yarn"), edges)).unionByName(own("gomod").where("direct").select("source", "idx"))
    return edges, roots.distinct()
