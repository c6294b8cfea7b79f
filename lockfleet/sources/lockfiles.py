"""Lockfiles as DataFrames: discovery, dispatch by file name, and the canonical tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockfleet import schema
from lockfleet.functions.text import scrub
from lockfleet.operators import resolve
from lockfleet.sources import gomod, npm, yarn
from lockfleet.sources.pip import requirements
from lockfleet.storage import drop, written


def format_of(name: Column) -> Column:
    """The format that a file's name says, null if none."""
    out = None
    for suffix, fmt, *_ in schema.FORMATS:
        out = (F.when if out is None else out.when)(name.endswith(suffix), fmt)
    return out


def _of_format(fmt: Column, at: int) -> Column:
    out = None
    for row in schema.FORMATS:
        out = (F.when if out is None else out.when)(fmt == row[1], F.lit(row[at]))
    return out


@dataclass
class Listing:
    """What discovery found in a local folder."""

    found: list[str]
    unreadable: list[str]
    unsupported: list[str]
    skipped: list[tuple[str, str]]


def discover(root: str) -> Listing:
    """Lockfiles below a local folder, in path order; symbolic links to folders aren't followed.

    Folders on the skip list, hidden ones and those over MAX_DEPTH deep are listed as skipped, and so is what begins with
    an underscore, which Spark's readers don't open. What vanishes meanwhile is silent; what can't be opened is unreadable.
    """
    found, unreadable, unsupported, skipped = set(), [], set(), []
    suffixes = tuple(f[0] for f in schema.FORMATS)
    stack = [(root, 0)]
    while stack:
        folder, depth = stack.pop()
        try:
            children = sorted(os.scandir(folder), key=lambda e: e.name)
        except FileNotFoundError:
            continue
        except OSError:
            unreadable.append(folder)
            continue
        for e in children:
            try:
                is_dir = e.is_dir()
                if e.is_symlink():
                    os.stat(e.path)
            except FileNotFoundError:
                continue
            except OSError:
                unreadable.append(e.path)
                continue
            if is_dir and e.is_symlink():
                skipped.append((e.path, "symlinked directory"))
            elif is_dir and e.name in schema.SKIPPED_DIRS:
                skipped.append((e.path, "on the skip list"))
            elif is_dir and e.name.startswith(".") and len(e.name) > 1:
                skipped.append((e.path, "hidden"))
            elif e.name.startswith("_") and (is_dir or e.name.endswith(suffixes)):
                skipped.append((e.path, "begins with an underscore"))
            elif is_dir and depth + 1 > schema.MAX_DEPTH:
                skipped.append((e.path, "below MAX_DEPTH"))
            elif is_dir:
                stack.append((e.path, depth + 1))
            elif e.is_file() and e.name.endswith(suffixes):
                found.add(e.path)
            elif e.is_file() and e.name in schema.UNSUPPORTED:
                unsupported.add(e.name)
    return Listing(sorted(found), sorted(unreadable), sorted(unsupported), sorted(skipped))


class Unusable(Exception):
    """A request that can't be served; its text says why."""


@dataclass
class Root:
    """A path as asked for, resolved: a file that was named, or a folder to look through."""

    path: str  # as sources are written: no scheme for local files, nothing escaped
    is_file: bool
    local: bool


def source_of(file_path: Column) -> Column:
    """A file's path as Spark tells it, decoded; local ones without a scheme."""
    plain = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "/")


def roots(spark: SparkSession, path: str) -> list[Root]:
    """What ``path`` names, in any store that Hadoop knows; a pattern names all that match it.

    Raises :class:`Unusable` where nothing is there, where it can't be read, and for what is neither file nor folder.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    asked = jvm.org.apache.hadoop.fs.Path(path)

    def resolved(p) -> Root:
        whole = fs.makeQualified(p)
        local = whole.toUri().getScheme() == "file"
        name = whole.toUri().getPath() if local else whole.toString()
        if local and os.path.lexists(name) and not (os.path.isfile(name) or os.path.isdir(name)):
            raise Unusable(f"{path}: neither a file nor a folder")
        if local and not os.access(name, os.R_OK) and os.path.lexists(name):
            raise Unusable(f"{path}: can't be read")
        is_file = fs.getFileStatus(whole).isFile()
        if is_file and name.rsplit("/", 1)[-1].startswith(("_", ".")):
            raise Unusable(f"{path}: Spark's readers don't open files whose names begin with _ or .")
        return Root(name, is_file, local)

    try:
        fs = asked.getFileSystem(conf)
        try:
            return [resolved(asked)]
        except Py4JJavaError as e:
            found = fs.globStatus(asked) if "FileNotFound" in e.java_exception.getClass().getName() else None
            if not found:
                raise
            return [resolved(x.getPath()) for x in found]
    except Py4JJavaError as e:
        missing = "FileNotFound" in e.java_exception.getClass().getName()
        raise Unusable(f"{path}: {'there is no such file or folder' if missing else 'cannot be read'}") from None


def _literal(path: str) -> str:
    """A path with what would be a pattern escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def entered(source: Column, folders: list[str]) -> Column:
    """Whether discovery, looking through ``folders`` (longer ones first), enters all folders between one of them and the file."""
    below = None
    for r in folders:
        below = (F.when if below is None else below.when)(source.startswith(r + "/"), F.substring(source, len(r) + 2, 1 << 20))
    parents = F.split(below, "/")
    dirs = F.slice(parents, 1, F.size(parents) - 1)
    return ~F.exists(dirs, lambda d: d.isin(*schema.SKIPPED_DIRS) | (d.startswith(".") & (F.length(d) > 1))) & (F.size(dirs) <= schema.MAX_DEPTH)


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(source, text)`` of lockfiles under shared paths, in any store that Spark reads.

    A file that is named is read whatever its name and folder; folders are looked through by the rules of
    :func:`discover`, which hold below the folder that is named. Each file has one row, however often it is named.
    """
    every = [r for p in ([paths] if isinstance(paths, str) else paths) for r in roots(spark, p)]
    named, folders = sorted({r.path for r in every if r.is_file}), sorted({r.path.rstrip("/") for r in every if not r.is_file}, key=lambda x: -len(x))
    source, parts = source_of(F.col("_metadata.file_path")), []
    if folders:
        globs = "{" + ",".join("*" + f[0] for f in schema.FORMATS) + "}"
        rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", globs).text([_literal(r) or "/" for r in folders], wholetext=True)
        rows = rows.select(source.alias("source"), F.col("value").alias("text"))
        rows = rows.where(entered(F.col("source"), folders))
        for linked in [p for r in every if r.local and not r.is_file for p, why in discover(r.path).skipped if why == "symlinked directory"]:
            rows = rows.where(~F.col("source").startswith(linked + "/"))
        rows = rows.where(~F.col("source").isin(named)) if named else rows
        nested = any(a != b and a.startswith(b + "/") for a in folders for b in folders)
        parts.append(rows.dropDuplicates(["source"]) if nested else rows)
    if named:
        parts.append(spark.read.text([_literal(r) for r in named], wholetext=True).select(source.alias("source"), F.col("value").alias("text")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass
class Tables:
    """The canonical tables (see ``schema``), each keyed by ``source``."""

    lockfiles: DataFrame
    packages: DataFrame
    edges: DataFrame
    errors: DataFrame
    parsed: tuple[DataFrame, ...]  # written, as all tables read them

    def persist(self) -> Tables:
        for t in (self.lockfiles, self.packages, self.edges, self.errors):
            t.persist()
        return self

    def release(self) -> None:
        """Gives back what is kept in memory and storage; the tables can't be read any more."""
        for t in (self.lockfiles, self.packages, self.edges, self.errors):
            t.unpersist()
        for t in self.parsed:
            drop(t)


#: Formats that are read in Catalyst; the others go one file at a time through Python.
NATIVE = {"npm": npm.parsed, "gomod": gomod.parsed, "yarn": yarn.parsed}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``schema.PARSED`` of each file, one at a time: a task holds one file's entries, and them once."""
    from lockfleet.sources.grammars import READERS, Refused

    deps = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "version", "src")]))
    flags = [(n, pa.bool_()) for n in ("dev", "optional", "first_party", "install_script", "has_integrity")]
    entry = pa.struct([*[(n, pa.string()) for n in ("name", "version", "key")], *flags, ("origin", pa.string()), ("src", pa.string()), ("direct", pa.bool_()), ("aliases", pa.list_(pa.string())), ("deps", deps)])
    parsed = pa.schema([("source", pa.string()), ("format", pa.string()), ("entries", pa.list_(entry)), ("wanted", pa.list_(pa.string())), ("scripts", pa.bool_()), ("what", pa.string()), ("line", pa.int32()), ("col", pa.int32())])

    def row(source: str, fmt: str, text: str) -> pa.RecordBatch:
        def batch(entries: pa.Array, *rest):
            whole = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
            return pa.RecordBatch.from_arrays([pa.array([source]), pa.array([fmt]), whole, *[pa.array([v], f.type) for v, f in zip(rest, list(parsed)[3:])]], schema=parsed)

        try:
            got = READERS[fmt](text)
            parts = []
            for at in range(0, len(got.entries), 1000):
                some = [vars(e) | {"deps": [dict(zip(("name", "version", "src"), d)) for d in e.deps]} for e in got.entries[at : at + 1000]]
                got.entries[at : at + 1000] = [None] * len(some)
                parts.append(pa.array(some, entry))
            return batch(pa.concat_arrays(parts) if parts else pa.array([], entry), got.roots, got.install_scripts, None, 0, 0)
        except Refused as e:
            return batch(pa.array([], entry), [], False, e.what, e.line, e.col)
        except Exception as e:  # noqa: BLE001  one bad file must not fail the fleet
            return batch(pa.array([], entry), [], False, f"not readable: {type(e).__name__}: {e}"[:500], 0, 0)

    for files_ in batches:
        for source, fmt, text in zip(*(files_.column(n) for n in ("source", "format", "text"))):
            yield row(source.as_py(), fmt.as_py(), text.as_py())


def _documents(raw: DataFrame, formats: list[str]) -> DataFrame:
    """``schema.PARSED`` of ``raw(source, format, text)``: a part for each native format, and one for all others."""
    parts = [NATIVE[f](raw.where(F.col("format") == f)) for f in formats if f in NATIVE]
    others = [f for f in formats if f not in NATIVE and f != "pip"]
    if others:
        parts.append(raw.where(F.col("format").isin(others)).select("source", "format", "text").mapInArrow(_parse, schema.PARSED))
    out = parts[0] if parts else raw.where(F.lit(False)).select(F.from_json(F.lit("{}"), schema.PARSED).alias("x")).select("x.*")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read(raw: DataFrame, formats: list[str] | None = None) -> Tables:
    """The canonical tables of ``raw(source, text)``.

    Only readers of ``formats`` run: of those that the caller says all files have, else of those that the files' names say.

    A file that can't be read has one row in ``errors`` and none elsewhere; the others are unaffected.
    Control characters in names, versions, keys and specifiers are scrubbed. ``idx`` follows the bytes
    of the keys for npm and pnpm, and the order in the file for the others.
    """
    raw = raw.withColumn("file_name", F.substring_index("source", "/", -1)).withColumn("format", format_of(F.col("file_name")))
    unknown = raw.where("format is null").select("source", F.lit("usage").alias("kind"), F.concat("file_name", F.lit(": not a lockfile that is known")).alias("what"), F.lit(0).alias("line"), F.lit(0).alias("col"))

    formats = formats or sorted(r[0] for r in raw.where("format is not null").select("format").distinct().collect())
    # each file is parsed once, not once for each table
    pip = requirements(raw.where("format = 'pip'").select("source", "text"))
    pip = written(pip, "requirements") if "pip" in formats else pip.where(F.lit(False))
    bad = pip.where("what is not null").groupBy("source").agg(F.min(F.struct("line", "col", "what")).alias("x"))
    pip_errors = bad.select("source", F.lit("syntax").alias("kind"), "x.what", "x.line", "x.col")
    numbered = pip.join(bad.select("source"), "source", "left_anti").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("line", "name", "version", "pin_kind", "pin_spec", "has_integrity", "origin"))).alias("x"))
    numbered = numbered.select("source", F.posexplode("x").alias("idx", "x"))
    false = F.lit(False)
    pip_packages = numbered.select("source", "idx", "x.name", "x.version", F.col("x.name").alias("key"), false.alias("dev"), false.alias("optional"), false.alias("first_party"), false.alias("install_script"), "x.has_integrity", "x.pin_kind", "x.pin_spec", "x.origin", F.lit(True).alias("is_root"))

    docs = written(_documents(raw, formats), "documents")
    refused = docs.where("what is not null")
    no_json = (F.col("format") == "npm") & (F.col("what") == npm.NOT_JSON)
    no_json_texts = raw.where("format = 'npm'").join(refused.where(no_json).select("source"), "source", "left_semi")
    doc_errors = refused.where(~no_json).select("source", "what", "line", "col")
    doc_errors = doc_errors.unionByName(npm.explained(no_json_texts)) if "npm" in formats else doc_errors
    doc_errors = doc_errors.select("source", F.when(F.col("line") > 0, "syntax").otherwise("usage").alias("kind"), "what", "line", "col")
    good = docs.where("what is null")
    entries = good.select("source", "format", F.posexplode("entries").alias("idx", "e")).select("source", "format", "idx", "e.*")
    edges, roots = resolve.all_formats(good, entries)
    flat = entries.select("source", "idx", "name", "version", "key", "dev", "optional", "first_party", "install_script", "has_integrity", F.lit("exact").alias("pin_kind"), F.lit(None).cast("string").alias("pin_spec"), "origin")
    flat = flat.join(roots.select("source", "idx", F.lit(True).alias("r")), ["source", "idx"], "left").withColumn("is_root", F.coalesce("r", false) & ~F.col("first_party")).drop("r")
    packages = flat.unionByName(pip_packages)
    for c in ("name", "version", "key", "pin_spec"):
        packages = packages.withColumn(c, scrub(F.col(c)))

    errors = unknown.unionByName(pip_errors).unionByName(doc_errors)
    scripts = good.select("source", "scripts")
    heads = raw.where("format is not null").select("source", "file_name", "format").join(bad.select("source").unionByName(refused.select("source")), "source", "left_anti").join(scripts, "source", "left")
    lockfiles = heads.select("source", "file_name", "format", _of_format(F.col("format"), 2).alias("ecosystem"), _of_format(F.col("format"), 3).alias("records_edges"), F.coalesce("scripts", F.lit(False)).alias("records_install_scripts"))
    return Tables(lockfiles, packages, edges, errors, (docs, pip))


def corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``(ecosystem, name)`` from text files of one normalised name a line."""
    out = spark.createDataFrame([], schema.CORPUS)
    for eco, path in paths.items():
        out = out.unionByName(spark.read.text(path).where("value <> ''").select(F.lit(eco).alias("ecosystem"), F.col("value").alias("name")))
    return out
