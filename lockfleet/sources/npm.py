"""package-lock.json in Catalyst: JSON as variants, its strictness and its fields as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockfleet import schema

MAX_JSON_DEPTH = 128
NOT_JSON = "not JSON"
_OBJECT = "map<string,variant>"
# The fields in which an entry names others.
DEPENDENCIES = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]


def strict_json(files: DataFrame) -> DataFrame:
    """``files(source, text)`` with ``doc``, a variant; null where the text isn't strict JSON (RFC 8259).

    Refused are what the parser refuses, text after the value, lone surrogates, and nesting deeper than MAX_JSON_DEPTH. A byte
    order mark before the text is skipped; of equal keys the last wins.
    """
    key = "spark.sql.variant.allowDuplicateKeys"
    conf = files.sparkSession.conf
    body = F.regexp_replace("text", "^\\x{feff}", "")
    no_strings = F.regexp_replace(F.regexp_replace("body", "(?s)\\\\.", ""), '"[^"]*"', "")
    # brackets outside of strings, by which depth is measured
    brackets = F.split(F.regexp_replace(no_strings, "[^\\[\\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"), F.lit(0).alias("most"))

    def step(d: Column, c: Column) -> Column:
        now = d["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.least(d["least"], now).alias("least"), F.greatest(d["most"], now).alias("most"))

    unescaped = F.replace("body", F.lit("\\\\"), F.lit(""))
    high, low = "\\\\u[dD][89abAB][0-9a-fA-F]{2}", "\\\\u[dD][c-fC-F]"
    lone = unescaped.rlike(f"{high}(?!{low})") | unescaped.rlike(f"(?<!{high}){low}")
    rows = files.withColumn("body", body)
    before = conf.get(key)
    conf.set(key, "true")
    try:
        # between brackets nothing can follow the value: the parser stops where an array ends
        rows = rows.withColumn("array", F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]"))))
        assert rows.schema is not None  # the setting is taken up when the column is resolved
    finally:
        conf.set(key, before)
    rows = rows.withColumn("depth", F.aggregate(brackets, start, step))
    one = F.try_variant_get("array", "$[1]", "variant").isNull()
    fine = one & (F.col("depth.least") >= 0) & (F.col("depth.most") <= MAX_JSON_DEPTH) & ~lone
    return rows.select(*files.columns, F.when(fine, F.try_variant_get("array", "$[0]", "variant")).alias("doc"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str) -> Column:
    """A field's text, null unless it is a string."""
    x = _field(v, name)
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _true(v: Column, name: str) -> Column:
    """Whether a field is ``true``."""
    x = _field(v, name)
    return F.coalesce(F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(v, f"$.{name}", "boolean")), F.lit(False))


def _names(v: Column) -> Column:
    """The names in all fields of dependencies; a name that is in two comes twice."""
    return F.flatten(F.array(*[F.coalesce(F.map_keys(F.try_variant_get(v, f"$.{k}", _OBJECT)), F.array().cast("array<string>")) for k in DEPENDENCIES]))


def _entry(key: Column, v: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.substring_index(key, "node_modules/", -1).alias("name"), F.coalesce(_text(v, "version"), F.lit("")).alias("version"), key.alias("key"),
        _true(v, "dev").alias("dev"), _true(v, "optional").alias("optional"), (~key.contains("node_modules/") | _true(v, "link")).alias("first_party"),
        _true(v, "hasInstallScript").alias("install_script"), _field(v, "integrity").isNotNull().alias("has_integrity"),
        F.when(F.coalesce(_text(v, "resolved"), F.lit("")).startswith("https://registry.npmjs.org/"), "registry").otherwise("elsewhere").alias("origin"),
        none.alias("src"), F.lit(False).alias("direct"), F.array().cast("array<string>").alias("aliases"),
        F.transform(_names(v), lambda n: F.struct(n.alias("name"), none.alias("version"), none.alias("src"))).alias("deps"),
    )


def parsed(files: DataFrame) -> DataFrame:
    """A row of ``schema.PARSED`` for each of ``files(source, text)``.

    Entries are in the order of their keys' bytes, with paths as keys; the nearest-ancestor lookup of dependencies is a join.
    """
    rows = strict_json(files.select("source", "text")).withColumn("version", _field(F.col("doc"), "lockfileVersion")).withColumn("packages", F.try_variant_get("doc", "$.packages", _OBJECT))
    number = F.when(F.schema_of_variant("version").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get("version", "$", "double"))
    what = (
        F.when(F.col("doc").isNull(), NOT_JSON)
        .when(number.isNull(), "lockfileVersion is missing, which npm always writes")
        .when(number < 2, F.concat(F.lit("of npm's versions 2 and 3 are read, not "), F.to_json("version")))
        .when(F.col("packages").isNull(), "`packages` is missing or no object")
    )
    # keys of variants come in nearly this order already, so few are compared more than once
    by_key = F.array_sort(F.map_entries("packages"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    rows = rows.select("source", what.alias("what"), by_key.alias("all")).withColumn("all", F.when(F.col("what").isNull(), F.col("all")))
    entries = F.transform(F.filter("all", lambda e: e["key"] != ""), lambda e: _entry(e["key"], e["value"]))
    wanted = F.flatten(F.transform(F.filter("all", lambda e: e["key"] == ""), lambda e: _names(e["value"])))
    nothing = F.array().cast(schema.ENTRIES)
    return rows.select("source", F.lit("npm").alias("format"), F.coalesce(entries, nothing).alias("entries"), F.coalesce(wanted, F.array().cast("array<string>")).alias("wanted"), F.col("what").isNull().alias("scripts"), "what", F.lit(0).alias("line"), F.lit(0).alias("col"))


def explained(refused: DataFrame) -> DataFrame:
    """``(source, what, line, col)`` for each of ``refused(source, text)``: what is wrong with a text that is no strict JSON, and where.

    The parser of variants doesn't tell; the few refused texts are read once more for it, in Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lockfleet.sources.grammars import Refused, strict_json

        for batch in batches:
            rows = []
            for source, text in zip(batch["source"], batch["text"]):
                try:
                    strict_json(text)
                    rows.append((source, NOT_JSON, 0, 0))
                except Refused as e:
                    rows.append((source, e.what, e.line, e.col))
                except Exception as e:  # noqa: BLE001  one bad file must not fail the fleet
                    rows.append((source, f"{NOT_JSON}: {type(e).__name__}", 0, 0))
            yield pd.DataFrame(rows, columns=["source", "what", "line", "col"])

    return refused.select("source", "text").mapInPandas(run, "source string, what string, line int, col int")
