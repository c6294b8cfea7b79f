"""requirements.txt in Catalyst: lines are joined, stripped and taken apart by Column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.functions.text import pin


def requirements(files: DataFrame) -> DataFrame:
    """``(source, line, name, version, pin_kind, pin_spec, has_integrity, origin, what, col)`` of each requirement.

    ``files(source, text)``. A line that can't be read has ``what`` and ``col`` set. Options and
    locations give no row; a backslash at a line's end joins it to the next.
    """
    # each logical line keeps the number of its first physical line: lines are numbered before they are joined
    lines = F.split(F.regexp_replace(F.regexp_replace("text", "\\r\\n", "\n"), "\\n$", ""), "\n")
    has_joins = F.col("text").rlike("\\\\(\\r?\\n|$)")
    numbered = lambda x: x.select("source", F.posexplode(lines).alias("line", "x")).withColumn("line", F.col("line") + 1)
    parts = numbered(files.where(has_joins))
    order = Window.partitionBy("source").orderBy("line")
    ends = F.col("x").endswith("\\")
    begins = (~F.coalesce(F.lag(ends).over(order), F.lit(False))).cast("int")
    parts = parts.withColumn("logical", F.sum(begins).over(order)).withColumn("x", F.regexp_replace("x", "\\\\$", ""))
    parts = parts.groupBy("source", "logical").agg(F.array_sort(F.collect_list(F.struct("line", "x"))).alias("p"))
    joined = parts.select("source", F.col("p")[0]["line"].alias("line"), F.array_join(F.col("p.x"), "").alias("x"))
    rows = numbered(files.where(~has_joins)).unionByName(joined)
    rows = rows.select("source", "line", F.regexp_replace("x", "(^|\\s)#.*$", "$1").alias("body"))
    text = F.regexp_replace("body", "^\\s+|\\s+$", "")
    col = F.length("body") - F.length(F.regexp_replace("body", "^\\s+", "")) + 1
    rows = rows.select("source", "line", col.alias("col"), text.alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("-"))
    options = F.regexp_extract("text", "(?:^|\\s)(-.*)$", 1)
    spec = F.regexp_replace(F.regexp_replace("text", "(?:^|\\s)-.*$", ""), "\\s+", "")
    head = F.substring_index(spec, ";", 1)
    rows = rows.select("source", "line", "col", options.rlike("(^|\\s)--hash").alias("has_integrity"), head.alias("head"))
    name = F.regexp_extract("head", "^([A-Za-z0-9._-]*)", 1)
    rows = rows.withColumn("name", name).withColumn("rest", F.expr("substring(head, length(name) + 1)"))
    rows = rows.where(F.col("rest").startswith("@") | ~F.col("rest").contains("/"))
    bare = F.when(F.col("rest").startswith("["), F.regexp_replace("rest", "^\\[[^\\]]*\\]", "")).otherwise(F.col("rest"))
    rows = rows.withColumn("bare", bare).withColumn("pin", pin(F.col("bare")))
    quoted = F.concat(F.lit("`"), F.col("head"), F.lit("`"))
    what = (
        F.when(~F.col("name").rlike("^[A-Za-z0-9]"), F.concat(quoted, F.lit(" does not begin with a package name")))
        .when(F.col("bare").startswith("["), F.concat(quoted, F.lit(" has an unclosed `[` in its extras")))
        .when(F.col("pin").isNull(), F.concat(quoted, F.lit(" is not a version specifier that is understood")))
    )
    origin = F.when(F.col("bare").startswith("@"), "elsewhere").otherwise("registry")
    return rows.select("source", "line", "name", F.col("pin.version").alias("version"), F.col("pin.kind").alias("pin_kind"), F.col("pin.spec").alias("pin_spec"), "has_integrity", origin.alias("origin"), what.alias("what"), "col")
