"""yarn.lock of version 1 in Catalyst: what a line belongs to is the last heading above it, by windows over numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockfleet import schema
from lockfleet.sources.gomod import numbered

# Headings within an entry whose lines are dependencies, registries, and the line that opens a file.
SECTIONS = ["dependencies", "optionalDependencies", "peerDependencies"]
REGISTRIES = ["https://registry.yarnpkg.com/", "https://registry.npmjs.org/"]
HEADER = "# yarn lockfile v1"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)^\\s+|\\s+\\z", "")


def _bare(x: Column) -> Column:
    """Without the quotes around it."""
    return F.when((F.length(x) >= 2) & x.startswith('"') & x.endswith('"'), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def _lines(files: DataFrame) -> DataFrame:
    """``(source, line, raw, body, specs, head, key, value, is_dep, error)``: ``head`` is the line of the entry that a line belongs to.

    An entry goes from its specifiers at the margin to the next ones, or to a comment at the margin. Lines of four columns or more under a heading
    of dependencies name dependencies, until a line of fewer columns ends them.
    """
    rows = numbered(files).withColumn("body", _stripped(F.col("raw")))
    said = (F.col("body") != "") & ~F.col("body").startswith("#")
    margin = ~F.col("raw").startswith(" ") & ~F.col("raw").startswith("\t")
    rows = rows.withColumn("is_head", said & margin).withColumn("is_inner", said & ~margin).withColumn("indent", F.length("raw") - F.length(F.regexp_replace("raw", "(?U)^\\s+", "")))
    cut = F.substring(F.col("raw"), F.lit(1), F.length("raw") - 1)
    specs = F.filter(F.transform(F.split(cut, ","), lambda s: _bare(_stripped(s))), lambda s: s != "")
    rows = rows.withColumn("specs", F.when(F.col("is_head"), specs))
    name = F.substring(F.col("body"), F.lit(1), F.length("body") - 1)
    rows = rows.withColumn("is_section", F.col("is_inner") & F.col("body").endswith(":") & ~name.rlike("(?U)\\s")).withColumn("is_pair", F.col("is_inner") & ~F.col("is_section"))
    rows = rows.withColumn("key", F.when(F.col("is_pair"), _bare(F.regexp_extract("body", "(?U)^(\\S+)", 1)))).withColumn("value", F.when(F.col("is_pair") & F.col("body").rlike("(?U)\\s"), _bare(_stripped(F.regexp_replace("body", "(?U)^\\S+\\s", "")))))
    upto = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("is_head"), True).when(F.col("body").startswith("#") & margin, False)
    deps = F.when(F.col("is_head"), False).when(F.col("is_section"), name.isin(SECTIONS)).when(F.col("is_pair") & (F.col("indent") < 4), False)
    last = lambda x, over: F.last(x, ignorenulls=True).over(over)
    rows = rows.withColumn("head", last(F.when(F.col("is_head"), F.col("line")), upto)).withColumn("inside", F.coalesce(last(opens, above), F.lit(False))).withColumn("in_deps", F.coalesce(last(deps, above), F.lit(False)))
    at = lambda col, what: F.struct(F.col("line"), col.cast("int").alias("col"), what.alias("what"))
    error = (
        F.when(F.col("is_head") & ~F.col("raw").endswith(":"), at(F.length("raw") + 1, F.lit("a line of specifiers without its colon")))
        .when(F.col("is_head") & (F.size("specs") == 0), at(F.lit(1), F.lit("a line of specifiers without a specifier")))
        .when(F.col("is_inner") & ~F.col("inside"), at(F.lit(1), F.lit("an indented line before the first entry")))
        .when(F.col("is_pair") & F.col("value").isNull(), at(F.lit(1), F.concat(F.lit("expected a key and a value: "), F.col("body"))))
    )
    is_dep = F.col("is_pair") & F.col("in_deps") & (F.col("indent") >= 4)
    return rows.select("source", "line", "raw", "body", "specs", "head", "key", "value", is_dep.alias("is_dep"), error.alias("error"))


def parsed(files: DataFrame) -> DataFrame:
    """A row of ``schema.PARSED`` for each of ``files(source, text)``: entries in the order of the file.

    An entry's specifiers are its aliases, and its dependencies are specifiers.
    """
    rows = _lines(files.select("source", "text"))
    # all lines of a file are in one task already, so its entries come together there
    field = lambda k: F.max_by(F.when((F.col("key") == k) & ~F.col("is_dep"), F.col("value")), F.when((F.col("key") == k) & ~F.col("is_dep"), F.col("line")))
    later = F.max(F.ltrim("body").startswith("__metadata:")).alias("later")
    known = F.max(F.regexp_replace("raw", "(?U)\\s+\\z", "") == HEADER).alias("known")
    dep = F.when(F.col("is_dep"), F.struct("line", F.concat("key", F.lit("@"), "value").alias("spec")))
    by_entry = rows.groupBy("source", "head").agg(F.min_by("specs", "line").alias("specs"), field("version").alias("version"), field("resolved").alias("resolved"), field("integrity").alias("integrity"), F.array_sort(F.collect_list(dep)).alias("deps"), F.min("error").alias("error"), later, known)

    spec = F.col("specs")[0]
    name = F.when(spec.rlike("(?s)^.+@[^@]*\\z"), F.regexp_extract(spec, "(?s)^(.+)@[^@]*\\z", 1)).otherwise(spec)
    none, no, version = F.lit(None).cast("string"), F.lit(False), F.coalesce("version", F.lit(""))
    resolved = F.coalesce("resolved", F.lit(""))
    entry = F.struct(
        name.alias("name"), version.alias("version"), F.concat(name, F.lit("@"), version).alias("key"), no.alias("dev"), no.alias("optional"), no.alias("first_party"), no.alias("install_script"), F.col("integrity").isNotNull().alias("has_integrity"),
        F.when(resolved.startswith(REGISTRIES[0]) | resolved.startswith(REGISTRIES[1]), "registry").otherwise("elsewhere").alias("origin"), none.alias("src"), no.alias("direct"), F.col("specs").alias("aliases"),
        F.transform("deps", lambda d: F.struct(d["spec"].alias("name"), none.alias("version"), none.alias("src"))).alias("deps"),
    )
    headed = F.col("head").isNotNull() & (F.size("specs") > 0)
    lacking = F.when(headed & (version == ""), F.struct(F.col("head").alias("line"), F.lit(1).alias("col"), F.lit("an entry without a version").alias("what")))
    by_file = by_entry.groupBy("source").agg(F.array_sort(F.collect_list(F.when(headed, F.struct("head", entry.alias("e"))))).alias("x"), F.min("error").alias("error"), F.min(lacking).alias("lacking"), F.max("later").alias("later"), F.max("known").alias("known"))
    missing = F.struct(F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("neither an entry nor Yarn's header line").alias("what"))
    newer = F.struct(F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("written by Yarn 2 or later; version 1 is read").alias("what"))
    error = F.when(F.col("later"), newer).otherwise(F.coalesce("error", "lacking", F.when((F.size("x") == 0) & ~F.col("known"), missing)))
    out = by_file.withColumn("error", error)
    entries = F.when(F.col("error").isNull(), F.transform("x", lambda x: x["e"])).otherwise(F.array().cast(schema.ENTRIES))
    return out.select("source", F.lit("yarn").alias("format"), entries.alias("entries"), F.array().cast("array<string>").alias("wanted"), no.alias("scripts"), "error.what", F.coalesce("error.line", F.lit(0)).alias("line"), F.coalesce("error.col", F.lit(0)).alias("col"))
