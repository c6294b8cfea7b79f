"""Counters, scores, gates and the text sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockfleet import schema
from lockfleet.functions.text import label, pad, thousands
from lockfleet.operators.rules import not_applicable

# The least score of each severity, and the headings and notes of the rules.
FLOORS = {4: 75, 3: 50, 2: 25, 1: 1}
HEADINGS = {"slopsquat": "HALLUCINATION RISK", "install-script": "INSTALL SCRIPTS", "trivial": "TRIVIAL", "drift": "VERSION DRIFT", "pinning": "UNPINNED"}
NOTES = {"slopsquat": "", "install-script": "arbitrary code at install time", "drift": "same package at 2+ versions in one tree", "pinning": "no exact version recorded"}
NAME_MIN, HEAD_MIN = 24, 22
SECTIONS = ["added", "removed", "changed", "introduced", "resolved"]


def counters(lockfiles: DataFrame, packages: DataFrame) -> DataFrame:
    """For each file: third-party packages, direct and transitive ones, workspace members, and how many have an integrity hash."""
    ours = F.col("first_party")
    a = packages.groupBy("source").agg(F.count_if(~ours).alias("packages"), F.count_if("is_root").alias("direct"), F.count_if(ours).alias("workspace"), F.count_if(~ours & F.col("has_integrity")).alias("integrity"))
    n = lambda c: F.coalesce(c, F.lit(0))
    out = lockfiles.select("source").join(a, "source", "left")
    return out.select("source", n("packages").alias("packages"), n("direct").alias("direct"), F.greatest(n("packages") - n("direct"), F.lit(0)).alias("transitive"), n("workspace").alias("workspace"), n("integrity").alias("integrity"))


def score(worst: Column, hits: Column) -> Column:
    """The risk score of ``hits`` findings at the worst severity; no band reaches the next."""
    floor = F.lit(0)
    for rank, least in FLOORS.items():
        floor = F.when(worst == rank, least).otherwise(floor)
    return F.coalesce((floor + F.floor(24 * hits / (hits + 8))).cast("int"), F.lit(0))


def risk(findings: DataFrame) -> DataFrame:
    """``(source, worst, risk)`` of files with findings; a file without any has risk 0."""
    by = findings.groupBy("source", "sev_rank").agg(F.count("*").alias("n")).groupBy("source").agg(F.max(F.struct("sev_rank", "n")).alias("x"))
    return by.select("source", F.col("x.sev_rank").alias("worst"), score(F.col("x.sev_rank"), F.col("x.n")).alias("risk"))


def blocks(findings: DataFrame) -> DataFrame:
    """``(source, rule, rule_rank, hits, worst)``."""
    return findings.groupBy("source", "rule", "rule_rank").agg(F.count("*").alias("hits"), F.max("sev_rank").alias("worst"))


def percentage(hits: Column, third: Column) -> Column:
    """Percent with one decimal place, rounded by the number's exact binary value, and to the even digit if it lies midway."""
    x = (100.0 * hits / F.greatest(third, F.lit(1))).cast("double")
    whole = F.floor(x)
    # twentieths, and what is over, in units of 2**-57: numbers of 1/32 and more have no finer digits
    units = ((x - whole) * F.lit(float(1 << 57))).cast("long") * 20
    k, over = F.shiftright(units, 57), units % F.lit(1 << 57)
    tenths = F.shiftright(k, 1) + F.when((k % 2 == 1) & ((over > 0) | (k % 4 == 3)), 1).otherwise(0)
    return F.concat((whole + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def gate(findings: DataFrame, fail_on: str) -> bool:
    """Whether a finding of this severity or a worse one is there."""
    rank = schema.SEVERITIES.index(fail_on.lower()) + 1
    return bool(findings.where(F.col("sev_rank") >= rank).take(1))


def exit_code(unreadable: bool, parsed: int, gated: bool) -> int:
    """2 if something could not be read or nothing was, else 1 if the gate was hit, else 0."""
    return 2 if unreadable or not parsed else int(gated)


_CONTROL = "[\\x00-\\x1f]"


def quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    code = lambda x: F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(x)), 2, "0")))
    others = lambda x: F.array_join(F.transform(F.split(x, ""), lambda y: F.when(y.rlike(_CONTROL), code(y)).otherwise(y)), "")
    # bound by a lambda, as the optimiser would write the whole expression out at each use
    once = F.transform(F.array(out), lambda x: F.when(x.rlike(_CONTROL), others(x)).otherwise(x))
    return F.concat(F.lit('"'), F.get(once, 0), F.lit('"'))


def _finding_json(x: Column) -> Column:
    return F.concat(F.lit('{"rule":'), quoted(x["rule"]), F.lit(',"severity":'), quoted(x["severity"]), F.lit(',"package":'), quoted(x["package"]), F.lit(',"version":'), quoted(x["version"]), F.lit(',"detail":'), quoted(x["detail"]), F.lit("}"))


def ndjson(lockfiles: DataFrame, packages: DataFrame, findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(source, line)``: one JSON object for each file, the same bytes each time."""
    order = F.struct("rule_rank", "package", "version", "severity", "detail", "rule")
    found = findings.groupBy("source").agg(F.array_sort(F.collect_list(order)).alias("f"))
    silent = not_applicable(lockfiles, corpus).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rule_rank", "rule"))).alias("s"))
    rows = lockfiles.select("source", "ecosystem").join(counters(lockfiles, packages), "source").join(risk(findings), "source", "left").join(found, "source", "left").join(silent, "source", "left")
    number = lambda key, c: F.concat(F.lit(f',"{key}":'), F.col(c).cast("string"))
    items = F.coalesce(F.array_join(F.transform("f", _finding_json), ","), F.lit(""))
    rules = F.coalesce(F.array_join(F.transform("s", lambda x: quoted(x["rule"])), ","), F.lit(""))
    rows = rows.withColumn("risk", F.coalesce("risk", F.lit(0)))
    line = F.concat(
        F.lit('{"source":'), quoted(F.col("source")), F.lit(',"ecosystem":'), quoted(F.col("ecosystem")), *[number(k, k) for k in ("packages", "direct", "transitive", "workspace", "integrity", "risk")], F.lit(',"findings":['), items, F.lit('],"not_applicable":['), rules, F.lit("]}")
    )
    return rows.select("source", line.alias("line"))


def diff_items(rows: DataFrame, section: str) -> DataFrame:
    """``(json, text)``: the items of a section of a diff in their order, a row each, however many there are."""
    if section in ("added", "removed"):
        order, as_json, text = ["identity"], quoted(F.col("identity")), F.col("identity")
    elif section == "changed":
        order = ["name", "from", "to"]
        as_json = F.concat(F.lit('{"name":'), quoted(F.col("name")), F.lit(',"from":'), quoted(F.col("from")), F.lit(',"to":'), quoted(F.col("to")), F.lit("}"))
        text = F.concat(pad(F.col("name"), NAME_MIN), F.lit(" "), F.col("from"), F.lit(" -> "), F.col("to"))
    else:
        order = ["rule_rank", "package", "version", "rule", "severity", "detail"]
        as_json = _finding_json({k: F.col(k) for k in order})
        text = F.concat(pad(label(F.col("package"), F.col("version")), NAME_MIN), F.lit(" "), F.col("detail"))
    return rows.orderBy(*order).select(as_json.alias("json"), text.alias("text"))


def diff_json(old: str, new: str, items: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """One JSON object of a diff in pieces, to be written one after another; ``items`` gives a section's objects in their order."""
    yield '{"old":' + json.dumps(old, ensure_ascii=False) + ',"new":' + json.dumps(new, ensure_ascii=False)
    for section in SECTIONS:
        yield f',"{section}":['
        for n, item in enumerate(items(section)):
            yield "," * (n > 0) + item
        yield "]"
    yield "}"


def human(lockfiles: DataFrame, packages: DataFrame, findings: DataFrame, corpus: DataFrame, verbose: bool = False, quiet: bool = False) -> DataFrame:
    """``(source, text)``: the report for people, without colour and timing; if quiet, the findings alone."""
    shown = F.lit(verbose) | (F.col("rule") == "slopsquat")
    counts = counters(lockfiles, packages)
    f = findings.withColumn("label", label(F.col("package"), F.col("version"))).withColumn("shown", shown)
    head = {k: i for i, k in enumerate(schema.RULES)}
    heading = F.get(F.array(*[F.lit(HEADINGS[r]) for r in schema.RULES]), "rule_rank")
    note = F.get(F.array(*[F.lit(NOTES.get(r, "")) for r in schema.RULES]), "rule_rank")
    width = f.where("shown").groupBy("source").agg(F.max(F.length("label")).alias("w"))
    f = f.join(width, "source", "left").join(counts.select("source", F.col("packages").alias("third")), "source")
    line = F.concat(F.lit("     "), pad(F.col("label"), F.greatest(F.col("w"), F.lit(NAME_MIN))), F.lit(" "), F.col("detail"), F.lit("\n"))
    by = f.groupBy("source", "rule", "rule_rank", "third").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("package", "version", line.alias("line"))))).alias("lines"))
    tail = F.when(F.col("rule") == "trivial", F.concat(F.lit("("), percentage(F.col("n"), F.col("third")), F.lit("% of third-party)"))).otherwise(note)
    block = F.concat(F.rtrim(F.concat(F.lit("  ⚠  "), pad(heading, HEAD_MIN), F.lit(" "), pad(F.col("n").cast("string"), 5), F.lit(" "), tail)), F.lit("\n"), F.array_join(F.col("lines.line"), ""), F.lit("\n"))
    body = by.select("source", "rule_rank", block.alias("b")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rule_rank", "b"))).alias("b"))
    silent = not_applicable(lockfiles, corpus).withColumn("h", heading).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rule_rank", F.concat(F.lit("  ·  "), pad(F.col("h"), HEAD_MIN), F.lit(" — no signal in this format\n")).alias("b")))).alias("s"))
    rows = lockfiles.select("source", "file_name").join(counts, "source").join(risk(findings), "source", "left").join(body, "source", "left").join(silent, "source", "left")
    workspace = F.when(F.col("workspace") == 0, "").otherwise(F.concat(F.lit(" · "), thousands(F.col("workspace")), F.lit(" workspace")))
    top = F.concat(F.lit("\n  "), pad(F.col("file_name"), NAME_MIN), F.lit(" "), thousands(F.col("packages")), F.lit(" packages   ("), thousands(F.col("direct")), F.lit(" direct · "), thousands(F.col("transitive")), F.lit(" transitive"), workspace, F.lit(")\n\n"))
    found = F.coalesce(F.array_join(F.col("b.b"), ""), F.lit("  no findings\n"))
    silent_rules = F.coalesce(F.concat(F.array_join(F.col("s.b"), ""), F.lit("\n")), F.lit(""))
    end = F.concat(F.lit("  risk "), F.coalesce("risk", F.lit(0)).cast("string"), F.lit("/100\n\n"))
    assert len(head) == len(HEADINGS)
    if quiet:
        return rows.select("source", F.coalesce(F.array_join(F.col("b.b"), ""), F.lit("")).alias("text"))
    return rows.select("source", F.concat(top, found, silent_rules, end).alias("text"))


def fleet(lockfiles: DataFrame, packages: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, packages and findings by ecosystem, with a total row (ecosystem null)."""
    p = third_party_counts(packages)
    f = findings.groupBy("source").agg(F.count("*").alias("f"))
    rows = lockfiles.select("source", "ecosystem").join(p, "source", "left").join(f, "source", "left")
    return rows.rollup("ecosystem").agg(F.count("*").alias("files"), F.coalesce(F.sum("p"), F.lit(0)).alias("packages"), F.coalesce(F.sum("f"), F.lit(0)).alias("findings"))


def third_party_counts(packages: DataFrame) -> DataFrame:
    return packages.where(~F.col("first_party")).groupBy("source").agg(F.count("*").alias("p"))
