"""The three commands over a fleet of lockfiles: scan, tree and diff."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockfleet import schema
from lockfleet.functions.text import label, normalize
from lockfleet.operators import diff as diffs
from lockfleet.operators import console, graph, report, rules, similarity
from lockfleet.operators.name_index import NameIndex
from lockfleet.sources import lockfiles
from lockfleet.sources.lockfiles import Tables, Unusable


@dataclass
class Scan:
    tables: Tables
    findings: DataFrame
    corpus: DataFrame

    def ndjson(self) -> DataFrame:
        return report.ndjson(self.tables.lockfiles, self.tables.packages, self.findings, self.corpus)

    def human(self, verbose: bool = False, quiet: bool = False) -> DataFrame:
        return report.human(self.tables.lockfiles, self.tables.packages, self.findings, self.corpus, verbose, quiet)

    def gate(self, fail_on: str) -> bool:
        return report.gate(self.findings, fail_on)


@dataclass
class Diff:
    old: str
    new: str
    added: DataFrame
    removed: DataFrame
    changed: DataFrame
    introduced: DataFrame
    resolved: DataFrame
    held: tuple = ()

    def release(self) -> None:
        """Gives back what is kept of both sides, which each section reads."""
        for x in self.held:
            x.release() if isinstance(x, Tables) else x.unpersist()

    def items(self, section: str) -> DataFrame:
        return report.diff_items(getattr(self, section), section)

    def json(self) -> Iterator[str]:
        """The JSON object in pieces; items come to the driver one partition at a time."""
        return report.diff_json(self.old, self.new, lambda section: (r.json for r in self.items(section).select("json").toLocalIterator()))

    def human(self, quiet: bool = False) -> Iterator[str]:
        """The lines for people."""

        def lines(section: str) -> Iterator[str]:  # starts no job before its first line is asked for
            for r in self.items(section).select("text").toLocalIterator():
                yield r.text

        return console.diff(self.old, self.new, ((s, getattr(self, s).count(), lines(s)) for s in report.SECTIONS), quiet)


class Engine:
    """Reads lockfiles with one session and a corpus of known names ``(ecosystem, name)``, or a stored index of them."""

    def __init__(self, spark: SparkSession, corpus: DataFrame | NameIndex | None = None):
        self.spark = spark
        self.near_known = corpus.nearest if isinstance(corpus, NameIndex) else None
        self.corpus = corpus.names() if isinstance(corpus, NameIndex) else spark.createDataFrame([], schema.CORPUS) if corpus is None else corpus

    def read(self, paths: str | list[str] | Tables) -> Tables:
        """The tables of what is under ``paths``; tables that were read already are served as they are."""
        return paths if isinstance(paths, Tables) else lockfiles.read(lockfiles.files(self.spark, paths))

    def scan(self, paths: str | list[str] | Tables, require_no_parent: bool = True) -> Scan:
        """All findings of all files under ``paths``; files that can't be read are in ``tables.errors``."""
        t = self.read(paths)
        return Scan(t, rules.audit(t.lockfiles, t.packages, t.edges, self.corpus, require_no_parent, self.near_known), self.corpus)

    def tree(self, paths: str | list[str] | Tables, package: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """Where a package stands: hits with in-degree and direct flag, and their ordered walks; see :meth:`near` if there are none."""
        t = self.read(paths)
        eco = t.lockfiles.select("source", "ecosystem", "records_edges")
        hits = t.packages.join(eco, "source").where(normalize(F.col("name"), F.col("ecosystem")) == normalize(F.lit(package), F.col("ecosystem")))
        kin = graph.parents(t.edges, t.packages).select("source", F.col("idx").alias("of"), F.col("parent_idx").alias("idx"))
        kin = kin.join(t.packages.select("source", "idx", "name", "version", graph.place(t.packages).alias("p")), ["source", "idx"])
        parents = kin.groupBy("source", F.col("of").alias("idx")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("p", "name", "version"))).alias("x"))
        parents = parents.select("source", "idx", "n", F.transform("x", lambda x: F.struct(x["name"].alias("name"), x["version"].alias("version"), x["p"]["key"].alias("key"))).alias("parents"))
        hits = hits.join(parents, ["source", "idx"], "left")
        degree = F.when(F.col("records_edges"), F.coalesce("n", F.lit(0)))
        hits = hits.select("source", "ecosystem", "idx", "name", "version", "key", "dev", "optional", "first_party", F.col("is_root").alias("direct"), "records_edges", degree.alias("in_degree"), "parents", graph.place(t.packages).alias("place"))
        walk = graph.walks(hits.select("source", F.col("idx").alias("hit")), t.packages, t.edges, depth)
        names = t.packages.select("source", "idx", "name", "version", label(F.col("name"), F.col("version")).alias("label"))
        return hits, walk.join(names, ["source", "idx"])

    def lookup(self, paths: str | list[str] | Tables, package: str, depth: int = 3) -> dict:
        """A lookup's occurrences with nested dependencies, or near names. Its rows are few."""
        t = self.read(paths)
        hits, walk = self.tree(t, package, depth)
        sizes = report.third_party_counts(t.packages.join(hits.select("source").distinct(), "source", "left_semi"))
        rows = hits.join(sizes, "source", "left").orderBy("source", "place").collect()
        steps: dict[tuple, list] = {}
        for w in walk.orderBy("source", "hit", "seq").collect():
            steps.setdefault((w.source, w.hit), []).append(w)
        found = []
        for h in rows:
            own = {k: h[k] for k in ("source", "ecosystem", "name", "version", "key", "dev", "optional", "first_party", "direct", "records_edges", "in_degree")}
            kin = [x.asDict() for x in h.parents or []] if h.records_edges else []
            found.append(own | {"packages": h.p or 0, "parents": kin, "dependencies": _nested(steps.get((h.source, h.idx), []))})
        near = [] if rows else [{"name": n.name, "distance": n.distance, "source": n.source} for n in self.near(t, package).collect()]
        return {"query": package, "found": bool(rows), "lockfiles": t.lockfiles.count(), "depth": depth, "occurrences": found, "near": near}

    def tree_json(self, paths: str | list[str] | Tables, package: str, depth: int = 3) -> str:
        """One JSON object of a lookup."""
        out = self.lookup(paths, package, depth)
        keys = ("source", "ecosystem", "name", "version", "key", "first_party", "direct", "records_edges", "in_degree")
        kin = lambda x: [{"name": p["name"], "version": p["version"]} for p in x["parents"]]
        out["occurrences"] = [{k: x[k] for k in keys} | {"parents": kin(x), "dependencies": x["dependencies"]} for x in out["occurrences"]]
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    def tree_text(self, paths: str | list[str] | Tables, package: str, depth: int = 3, where: str = "", quiet: bool = False) -> Iterator[str]:
        """The lines of a lookup for people; ``where`` names what was looked through."""
        return console.tree(self.lookup(paths, package, depth), where or str(paths), quiet)

    def near(self, paths: str | list[str] | Tables, package: str) -> DataFrame:
        """The closest names in the fleet, eight at most."""
        t = self.read(paths)
        return similarity.near_names(t.packages.join(t.lockfiles.select("source", "ecosystem"), "source"), package)

    def diff(self, old: str, new: str) -> Diff:
        """What changed between two lockfiles of one ecosystem."""
        a, b = self.read(old).persist(), self.read(new).persist()
        kinds = [t.lockfiles.select("ecosystem").distinct().take(2) for t in (a, b)]
        if not all(kinds) or kinds[0] != kinds[1]:
            a.release(), b.release()
            unread = [path for path, k in zip((old, new), kinds) if not k]
            raise Unusable(f"{unread[0]} can't be read" if unread else f"{old} and {new} are different ecosystems ({kinds[0][0][0]} and {kinds[1][0][0]}); there is nothing to compare")
        fa, fb = (rules.audit(t.lockfiles, t.packages, t.edges, self.corpus, near=self.near_known).persist() for t in (a, b))
        p, q = a.packages, b.packages
        return Diff(old, new, diffs.added(p, q), diffs.added(q, p), diffs.changed(p, q), diffs.introduced(fa, fb), diffs.introduced(fb, fa), (a, b, fa, fb))


def _nested(steps: list) -> list[dict]:
    """Rows of a walk in preorder as nested objects."""
    top: list[dict] = []
    open_ = [top]
    for w in steps:
        node = {"name": w.name, "version": w.version}
        if w.stop:
            node |= {"stop": w.stop} | ({"hidden": w.hidden} if w.stop == "depth" else {})
        node["dependencies"] = []
        del open_[w.depth :]
        open_[-1].append(node)
        open_.append(node["dependencies"])
    return top


def blind_spots(listing: lockfiles.Listing, as_json: bool = True, verbose: bool = False, quiet: bool = False) -> str:
    """What a scan could not see, for people or as the JSON object that has no source; empty if nothing. If quiet, failures alone."""
    if quiet:
        listing, verbose = lockfiles.Listing(listing.found, listing.unreadable, [], []), False
    if as_json:
        seen = {"unreadable": listing.unreadable, "unsupported": listing.unsupported}
        return json.dumps(seen, ensure_ascii=False, separators=(",", ":")) if any(seen.values()) else ""
    # The wording of these lines, which readers of the output may look for.
    out = []
    if n := len(listing.unreadable):
        out += ["", f"  could not look inside {n} path{'s' * (n > 1)} — this scan is incomplete", *("     " + p for p in listing.unreadable)]
    if listing.unsupported:
        out += ["", "  found but not read: " + ", ".join(listing.unsupported)]
    if verbose and listing.skipped:
        out += ["", f"  not descended into ({len(listing.skipped)})", *(f"     {p} {why}" for p, why in listing.skipped)]
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    """``scan PATH``, ``tree PACKAGE PATH`` and ``diff OLD NEW``; exit codes 0, 1 (gate hit) and 2."""
    p = argparse.ArgumentParser(prog="lockfleet")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in (("scan", ["path"]), ("tree", ["package", "path"]), ("diff", ["old", "new"])):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, **{"nargs": "?", "default": "."} if a == "path" else {})
        c.add_argument("--format", choices=["human", "json"], default="human")
        c.add_argument("--corpus", action="append", default=[], metavar="ECOSYSTEM=FILE")
        c.add_argument("--fail-on", choices=schema.SEVERITIES)
        c.add_argument("--depth", type=int, default=3)
        c.add_argument("-v", "--verbose", action="store_true")
        c.add_argument("-q", "--quiet", action="store_true")
        c.add_argument("--no-color", action="store_true", help="output has no colours in any case")
    o = p.parse_args(argv)
    spark = SparkSession.builder.appName("lockfleet").getOrCreate()
    engine = Engine(spark, lockfiles.corpus(spark, dict(x.split("=", 1) for x in o.corpus)))
    try:
        for path in {"diff": ("old", "new")}.get(o.command, ("path",)):
            lockfiles.roots(spark, getattr(o, path))
        if o.command == "diff":
            d = engine.diff(o.old, o.new)
            if o.format == "json":
                for piece in d.json():
                    print(piece, end="")
                print()
            else:
                for line in d.human(o.quiet):
                    print(line)
            gated = bool(o.fail_on) and report.gate(d.introduced, o.fail_on)
            d.release()
            return int(gated)
        if o.command == "tree":
            if o.format == "json":
                print(engine.tree_json(o.path, o.package, o.depth))
            else:
                print(*engine.tree_text(o.path, o.package, o.depth, o.path, o.quiet), sep="\n")
            return 0
        listing = lockfiles.discover(o.path) if os.path.isdir(o.path) else lockfiles.Listing([], [], [], [])
        if said := blind_spots(listing, o.format == "json", o.verbose, o.quiet):
            print(said)
        s = engine.scan(o.path)
        errors = s.tables.errors.orderBy("source").collect()
        for e in errors:
            print(f"{e.source}:{e.line}:{e.col}: {e.what}", file=sys.stderr)
        out = (s.ndjson() if o.format == "json" else s.human(o.verbose, o.quiet)).orderBy("source").toLocalIterator()
        n = 0
        for n, row in enumerate(out, 1):
            if row[1]:
                print(row[1])
        return report.exit_code(bool(listing.unreadable), n, bool(o.fail_on) and s.gate(o.fail_on))
    except Unusable as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
