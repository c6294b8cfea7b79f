"""go.mod in Catalyst: lines are numbered, and windows fill blocks down and bring modules to what replaces them; one shuffle, by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockfleet import schema

# The directives of go.mod, and what a version looks like.
DIRECTIVES = ["module", "go", "toolchain", "require", "exclude", "replace", "retract", "godebug", "tool", "ignore"]
VERSION = "^v[0-9]+\\.[0-9]+\\.[0-9]+([-+][A-Za-z0-9.+_-]*)?\\z"


def numbered(files: DataFrame) -> DataFrame:
    """``(source, line, raw)``: the lines of ``files(source, text)``, from 1, without their ends; an empty text has one."""
    lines = F.split(F.regexp_replace("text", "\\n\\z", ""), "\n")
    return files.select("source", F.posexplode(lines).alias("line", "raw")).select("source", (F.col("line") + 1).alias("line"), F.regexp_replace("raw", "\\r\\z", "").alias("raw"))


def _column_of(index: Column) -> Column:
    """Where the token of this number (from 0) begins in ``body``, from 1."""
    return F.expr(f"length(regexp_extract(body, concat('(?U)^(\\\\s*(?:\\\\S+\\\\s+){{', {index}, '}})'), 1)) + 1") if isinstance(index, str) else F.length(F.regexp_extract("body", f"(?U)^(\\s*(?:\\S+\\s+){{{index}}})", 1)) + 1


def _directives(files: DataFrame) -> DataFrame:
    """``(source, line, kind, args, note, error, open)``: each line that says something, the block that is open after it, and what is wrong with it.

    ``kind`` is null where a block begins or ends. A block is the first that begins after the last end, which fills down to its own end.
    """
    rows = numbered(files).withColumn("body", F.substring_index("raw", "//", 1))
    tokens = F.regexp_extract_all("body", F.lit("(?U)\\S+"), F.lit(0))
    rows = rows.withColumn("tokens", tokens).withColumn("note", F.regexp_replace(F.expr("substring(raw, length(body) + 3)"), "(?U)^\\s+|\\s+\\z", ""))
    rows = rows.where((F.size("tokens") > 0) | (F.col("line") == 1))

    quoted = lambda t: t.startswith('"') | t.startswith("`")
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    said = F.transform("tokens", lambda t: F.when(quoted(t), inner(t)).otherwise(t))
    wrong = lambda t: (
        F.when(quoted(t) & ((F.length(t) < 2) | (F.right(t, F.lit(1)) != F.left(t, F.lit(1)))), F.concat(F.lit("a quoted string without its end: "), t))
        .when(quoted(t) & inner(t).contains("\\"), F.concat(F.lit("escapes in quoted strings are not read: "), t))
    )
    rows = rows.withColumn("said", said).withColumn("wrong", F.transform("tokens", wrong)).withColumn("at", F.expr("array_position(transform(wrong, x -> x is not null), true)"))
    n, first = F.size("said"), F.get("said", F.lit(0))
    rows = rows.withColumn("n", n).withColumn("first", first).withColumn("col", _column_of(0))
    begins = F.coalesce(F.col("first").isin(DIRECTIVES) & (F.get("said", F.lit(1)) == "("), F.lit(False))
    ends = F.coalesce(F.col("first") == ")", F.lit(False))
    order = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begins", begins).withColumn("ends", ends).withColumn("part", F.coalesce(F.sum(F.col("ends").cast("int")).over(order), F.lit(0)))
    order = Window.partitionBy("source", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.struct("first", "line", "col")
    rows = rows.withColumn("block", F.first(F.when(F.col("begins") & (F.col("n") == 2), mark), ignorenulls=True).over(order))

    inside = F.col("block").isNotNull()
    kind = F.when(inside & ~F.col("ends"), F.col("block.first")).when(~inside & ~F.col("begins") & F.col("first").isin(DIRECTIVES), F.col("first"))
    args = F.when(inside, F.col("said")).otherwise(F.slice("said", 2, 1 << 30))
    rows = rows.withColumn("inside", inside).withColumn("kind", F.when(F.col("n") > 0, kind)).withColumn("args", args)
    k, count, arrow = F.col("kind"), F.size("args"), F.array_position("args", "=>")
    expected = lambda what: F.struct(F.col("line"), F.col("col"), what.alias("what"))
    at = lambda token, what: F.struct(F.col("line"), _column_of(token).alias("col"), what.alias("what"))
    version = F.get("args", F.lit(1))
    bad_version = F.concat(F.lit("a version begins with v and a digit, unlike "), version)
    error = (
        F.when(F.col("n") == 0, None)
        .when(F.col("at") > 0, at("at - 1", F.expr("wrong[int(at) - 1]")))
        .when(F.col("inside") & F.col("ends"), F.when(F.col("n") > 1, at(1, F.lit("text after the bracket that ends a block"))))
        .when(~F.col("inside") & ~F.coalesce(F.col("first").isin(DIRECTIVES), F.lit(False)), expected(F.concat(F.lit("unknown directive "), F.col("first"))))
        .when(~F.col("inside") & F.col("begins"), F.when(F.col("n") > 2, at(2, F.concat(F.lit("text after the bracket that begins a block of "), F.col("first")))))
        .when((k == "module") & (count != 1), expected(F.lit("expected: module PATH")))
        .when(k.isin("require", "exclude") & (count != 2), expected(F.concat(F.lit("expected: "), k, F.lit(" PATH VERSION"))))
        .when(k.isin("require", "exclude") & ~version.rlike(VERSION), F.when(F.col("inside"), at(1, bad_version)).otherwise(at(2, bad_version)))
        .when((k == "replace") & (arrow == 0), expected(F.lit("expected: replace OLD => NEW")))
        .when((k == "replace") & ((arrow == 1) | (arrow == count)), expected(F.lit("a path is missing beside the arrow of replace")))
    )
    after = F.when(F.col("ends"), None).when(F.col("inside"), F.col("block")).when(F.col("begins") & (F.col("n") == 2), mark)
    return rows.select("source", "line", "kind", "args", "note", error.alias("error"), after.alias("open"))


def parsed(files: DataFrame) -> DataFrame:
    """A row of ``schema.PARSED`` for each of ``files(source, text)``: required modules in the order of the file.

    A module that is replaced comes from elsewhere, and is first-party if its replacement is a path.
    """
    rows = _directives(files.select("source", "text"))
    said = lambda kind: (F.col("kind") == kind) & F.col("error").isNull()
    rows = rows.withColumn("path", F.when(said("require") | said("replace"), F.col("args")[0]))
    to = F.get("args", F.array_position("args", "=>").cast("int"))  # the position counts from 1: this is what follows
    # a module meets what replaces it, the last if there are several, wherever in the file that stands
    met = Window.partitionBy("source", "path")
    rows = rows.withColumn("to", F.max_by(F.when(said("replace"), to), F.when(said("replace"), F.col("line"))).over(met))
    version, indirect = F.col("args")[1], (F.col("note") == "indirect") | F.col("note").startswith("indirect;")
    none, no = F.lit(None).cast("string"), F.lit(False)
    ours = F.coalesce(F.col("to").startswith(".") | F.col("to").startswith("/"), no)
    entry = F.struct(
        F.col("path").alias("name"), version.alias("version"), F.col("path").alias("key"), no.alias("dev"), no.alias("optional"), ours.alias("first_party"), no.alias("install_script"), no.alias("has_integrity"),
        F.when(F.col("to").isNull(), "registry").otherwise("elsewhere").alias("origin"), none.alias("src"), (~indirect).alias("direct"), F.array().cast("array<string>").alias("aliases"), F.array().cast(schema.DEPS).alias("deps"),
    )
    entries = F.array_sort(F.collect_list(F.when(said("require"), F.struct("line", entry.alias("e")))))
    out = rows.groupBy("source").agg(F.min("error").alias("error"), F.max_by("open", "line").alias("open"), F.max(F.coalesce(F.col("kind") == "module", F.lit(False))).alias("module"), F.transform(entries, lambda x: x["e"]).alias("entries"))
    left_open = F.concat(F.lit("the file ends inside a block of "), F.col("open.first"))
    what = F.coalesce("error.what", left_open, F.when(~F.col("module"), "the module directive is missing"))
    out = out.withColumn("what", what).withColumn("line", F.coalesce("error.line", "open.line", F.lit(0))).withColumn("col", F.coalesce("error.col", "open.col", F.lit(0)))
    good = F.when(F.col("what").isNull(), F.col("entries"))
    return out.select("source", F.lit("gomod").alias("format"), F.coalesce(good, F.array().cast(schema.ENTRIES)).alias("entries"), F.array().cast("array<string>").alias("wanted"), no.alias("scripts"), "what", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"))
