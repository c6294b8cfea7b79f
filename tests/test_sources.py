import pytest

from lockfleet.plans.engine import Engine, Unusable
from lockfleet.sources import grammars as G
from lockfleet.sources.lockfiles import discover, files, read
from lockfleet.sources.pip import requirements

# A requirements file whose report is known in full.
POISONED = "requests==2.31.0\nurllib3>=1.26\npython-dateutils==2.9.0\nrequests-http==1.0.2\nflask~=3.0\nnumpy\n"
NPM = '{"lockfileVersion":3,"packages":{"":{"dependencies":{"expres":"^1"}%s},"node_modules/expres":{"version":"1.0.0","resolved":"https://registry.npmjs.org/expres/-/e.tgz"}%s}}'
PNPM = """lockfileVersion: '9.0'
importers:
  .:
    dependencies:
      a: {specifier: ^1, version: 1.0.0(b@2.0.0)}
packages:
  a@1.0.0: {resolution: {integrity: x}}
  b@2.0.0: {resolution: {integrity: x}}
  c@3.0.0: {resolution: {integrity: x, tarball: t}}
snapshots:
  a@1.0.0(b@2.0.0):
    dependencies:
      b: 2.0.0(c@3.0.0)
  b@2.0.0(c@3.0.0):
    optional: true
    dependencies:
      c: 3.0.0
"""
CARGO = """[[package]]
name = "app"
version = "0.1.0"
dependencies = ["x 1.0.0 (reg2)", "y"]
[[package]]
name = "x"
version = "1.0.0"
source = "registry+reg1"
checksum = "c"
dependencies = ["y"]
[[package]]
name = "x"
version = "1.0.0"
source = "reg2"
[[package]]
name = "y"
version = "2.0.0"
source = "registry+reg1"
"""
UV = """requires-python = ">=3"
[[package]]
name = "me"
source = { editable = "." }
dependencies = [{ name = "A_b", version = "2" }, { name = "c" }]
[[package]]
name = "a-b"
version = "1"
source = { registry = "r" }
[[package]]
name = "a-b"
version = "2"
source = { registry = "r" }
sdist = { hash = "h" }
dependencies = [{ name = "a-b" }]
[[package]]
name = "c"
version = "3"
source = { git = "g" }
"""
POETRY = """[[package]]
name = "Top"
version = "1"
groups = ["main"]
[package.dependencies]
low_er = "*"
[[package]]
name = "low-er"
version = "2"
groups = ["dev"]
files = [{ file = "f", hash = "h" }]
[metadata]
lock-version = "2.0"
"""
GO = 'module ex.org/m\n\ngo 1.22\nrequire (\n\ta.b/c v1.2.3\n\t"d.e/f" v0.0.0-2020-abc // indirect\n)\nrequire g.h/i v1.0.0 // indirect; x\nreplace d.e/f => ../local\nexclude a.b/c v1.0.0\n'
YARN = '# yarn lockfile v1\n\n"@s/far@^1", far2@^1:\n  version "1.0.0"\n  resolved "https://registry.yarnpkg.com/x"\n  integrity sha512-x\n  dependencies:\n    oop "^2"\n\noop@^2, oop@^2.1:\n  version "2.1.0"\n  resolved "https://elsewhere/x"\n'


def tables(spark, **files):
    t = read(spark.createDataFrame([(k.replace("__", "/"), v) for k, v in files.items()], "source string, text string"))
    p = {(r.source, r.idx): r for r in t.packages.collect()}
    e = sorted(map(tuple, t.edges.collect()))
    return t, p, e


def test_all_formats(spark):
    names = {"n/package-lock.json": NPM % ("", ""), "p/pnpm-lock.yaml": PNPM, "c/Cargo.lock": CARGO, "u/uv.lock": UV, "o/poetry.lock": POETRY, "g/go.mod": GO, "y/yarn.lock": YARN, "r/requirements.txt": POISONED, "z/readme": "", "b/Cargo.lock": "x = ", "b/go.mod": "module a\nnope\n", "b/requirements.txt": "ok\n\n  =bad # x\n"}
    t, p, e = tables(spark, **names)
    edges = lambda s: [(a, b) for src, a, b in e if src == s]
    roots = lambda s: sorted(i for (src, i), r in p.items() if src == s and r.is_root)
    assert edges("p/pnpm-lock.yaml") == [(0, 1), (1, 2)] and roots("p/pnpm-lock.yaml") == [0]
    assert [p["p/pnpm-lock.yaml", i].origin for i in range(3)] == ["registry", "registry", "elsewhere"] and p["p/pnpm-lock.yaml", 1].optional
    assert edges("c/Cargo.lock") == [(1, 3)] and roots("c/Cargo.lock") == [2, 3]
    assert edges("u/uv.lock") == [(2, 1)] and roots("u/uv.lock") == [2, 3]
    assert edges("o/poetry.lock") == [(0, 1)] and roots("o/poetry.lock") == [0] and p["o/poetry.lock", 1].dev and p["o/poetry.lock", 1].has_integrity
    assert roots("g/go.mod") == [0] and p["g/go.mod", 1].first_party and p["g/go.mod", 1].origin == "elsewhere" and not edges("g/go.mod")
    assert edges("y/yarn.lock") == [(0, 1)] and roots("y/yarn.lock") == [0] and p["y/yarn.lock", 0].key == "@s/far@1.0.0"
    assert roots("n/package-lock.json") == [0]
    errors = {r.source: (r.kind, r.line, r.col) for r in t.errors.collect()}
    assert errors == {"z/readme": ("usage", 0, 0), "b/Cargo.lock": ("syntax", 1, 5), "b/go.mod": ("syntax", 2, 1), "b/requirements.txt": ("syntax", 3, 3)}
    assert {r.source for r in t.lockfiles.collect()} == set(names) - set(errors)


def test_npm_nearest_ancestor(spark):
    text = '{"lockfileVersion":2,"packages":{"":{"dependencies":{"a":"1"}},"apps/d":{"dependencies":{"x":"1"}},"apps/d/node_modules/x":{},"node_modules/x":{},"node_modules/a":{"dependencies":{"x":"1","y":"1"}},"node_modules/a/node_modules/x":{"peerDependencies":{"x":"1","a":"1"}},"node_modules/l":{"link":true}}}'
    _, p, e = tables(spark, **{"package-lock.json": text})
    at = {r.key: i for (_, i), r in p.items()}
    assert [(a, b) for _, a, b in e] == sorted([(at["node_modules/a"], at["node_modules/a/node_modules/x"]), (at["node_modules/a/node_modules/x"], at["node_modules/a/node_modules/x"]), (at["node_modules/a/node_modules/x"], at["node_modules/a"])])  # a peer named like the entry is the entry: the nearest place is its own
    assert {r.key for r in p.values() if r.is_root} == {"node_modules/a", "apps/d/node_modules/x"}
    assert {r.key for r in p.values() if r.first_party} == {"apps/d", "node_modules/l"}


@pytest.mark.parametrize(("reader", "text"), [(G.strict_json, '{"a":NaN}'), (G.strict_json, '"\\ud800"'), (G.strict_json, "[1,]"), (G.strict_json, "[" * 200 + "]" * 200), (G.yaml, "a: 1\na: 2"), (G.yaml, "a: &x 1\nb: *x"), (G.yaml, "a: !!int 1"), (G.yaml, "a: [1"), (G.toml, "a = 1\na = 2"), (G.pnpm, "lockfileVersion: '5.4'"), (G.cargo, ""), (G.cargo, '[[package]]\nname = "x"'), (G.uv, ""), (G.poetry, "")])
def test_refusals(reader, text):
    with pytest.raises(G.Refused):
        reader(text)


def test_yaml_keeps_strings():
    assert G.yaml("no: on\nv: 9.0\nt: true\nf: 'true'\ne:\n") == {"no": "on", "v": "9.0", "t": True, "f": "true", "e": None}


def test_mangled_documents_never_fail_a_job(spark):
    import random

    rng, rows = random.Random(0x5DEECE66D), []
    for name, text in (("package-lock.json", NPM % ("", "")), ("pnpm-lock.yaml", PNPM), ("Cargo.lock", CARGO), ("uv.lock", UV), ("poetry.lock", POETRY), ("go.mod", GO), ("yarn.lock", YARN), ("requirements.txt", POISONED)):
        for k in range(40):
            cut = list(text)
            for _ in range(rng.randrange(1, 6)):
                at = rng.randrange(len(cut))
                cut[at : at + rng.randrange(3)] = rng.choice(["", "\0", "\\", '"', "[", "{", "é", "\n", ":", "=", "#"])
            rows.append((f"{k}/{name}", "".join(cut)))
    t = read(spark.createDataFrame(rows, "source string, text string"))
    read_, failed = t.lockfiles.count(), t.errors.count()
    assert read_ + failed == len(rows)


def test_poisoned_line(spark, tmp_path):
    (tmp_path / "poisoned.requirements.txt").write_text(POISONED)
    names = ["requests", "urllib3", "python-dateutil", "requests-html", "flask", "numpy"]
    corpus = spark.createDataFrame([("pypi", n) for n in names], "ecosystem string, name string")
    line = Engine(spark, corpus).scan(str(tmp_path)).ndjson().first()["line"]
    want = '","ecosystem":"pypi","packages":6,"direct":6,"transitive":0,"workspace":0,"integrity":0,"risk":79,"findings":[{"rule":"slopsquat","severity":"critical","package":"python-dateutils","version":"2.9.0","detail":"not in corpus · d=1 from \\"python-dateutil\\" · no dependency graph in this format"},{"rule":"slopsquat","severity":"critical","package":"requests-http","version":"1.0.2","detail":"not in corpus · d=2 from \\"requests-html\\" · no dependency graph in this format"},{"rule":"pinning","severity":"low","package":"flask","version":"","detail":"~=3.0 · capped at the major, still floats below the cap"},{"rule":"pinning","severity":"high","package":"numpy","version":"","detail":"no bound in either direction · resolves to whatever is newest at install time"},{"rule":"pinning","severity":"medium","package":"urllib3","version":"","detail":">=1.26 · a range, so the file does not say what installs"}],"not_applicable":["install-script"]}'
    assert line.endswith(want)


def test_parents_matter(spark):
    corpus = spark.createDataFrame([("npm", "express"), ("npm", "body-parser")], "ecosystem string, name string")
    from lockfleet.operators.rules import slopsquat

    def found(text):
        t, *_ = tables(spark, **{"package-lock.json": text})
        return [r.detail for r in slopsquat(t.lockfiles, t.packages, t.edges, corpus).collect()]

    assert found(NPM % ("", "")) == ['not in corpus · d=1 from "express" · root-only, no parent']
    assert found(NPM % (',"x":1', ',"node_modules/body-parser":{"version":"1.0.0","resolved":"https://registry.npmjs.org/b","dependencies":{"expres":"1"}}')) == []


def test_discovery_and_errors(spark, tmp_path):
    for name in ("a/go.mod", "a/node_modules/x/package-lock.json", ".hid/uv.lock", "a/b/dev-requirements.txt", "a/Gemfile.lock", "1/2/3/4/5/6/7/go.mod"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("module x\n" if name.endswith("go.mod") else "a\n")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = discover(str(tmp_path))
    assert [x[len(str(tmp_path)) + 1 :] for x in got.found] == ["a/b/dev-requirements.txt", "a/go.mod"]
    assert got.unsupported == ["Gemfile.lock"] and {r for _, r in got.skipped} == {"on the skip list", "hidden", "below MAX_DEPTH", "symlinked directory"}
    s = Engine(spark).scan(str(tmp_path))
    assert {r.source.split("/")[-1] for r in s.tables.lockfiles.collect()} == {"go.mod", "dev-requirements.txt"}
    with pytest.raises(Unusable):
        Engine(spark).diff(str(tmp_path / "a/go.mod"), str(tmp_path / "a/b/dev-requirements.txt"))


@pytest.mark.parametrize("folder", ["1/2/3/4/5/6/7/8", "vendor", "j k", "a[b]+c%20", ".hid/x", "node_modules/y"])
def test_named_files_and_folders_are_read(spark, tmp_path, folder, monkeypatch):
    below = tmp_path / folder
    below.mkdir(parents=True)
    (below / "go.mod").write_text("module x\n")
    named, engine = str(below / "go.mod"), Engine(spark)
    for path in (named, "file://" + named, "file:" + named, str(below), str(below) + "/", "file://" + str(below)):
        assert [tuple(r) for r in files(spark, path).collect()] == [(named, "module x\n")], path
    assert [r.source for r in files(spark, [named, str(below), named]).collect()] == [named]
    assert discover(str(below)).found == [named]
    if folder == "vendor":
        d = engine.diff(named, named)
        assert not d.added.count() and not d.changed.count()


def test_walks_agree(spark, tmp_path):
    for name in ("a/go.mod", "_b/go.mod", "a/_go.mod", "a/j k/go.mod", "vendor/go.mod", "1/2/3/4/5/6/go.mod", "1/2/3/4/5/6/7/go.mod"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("module x\n")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = sorted(r.source for r in files(spark, str(tmp_path)).collect())
    assert got == discover(str(tmp_path)).found == sorted(str(tmp_path / x) for x in ("a/go.mod", "a/j k/go.mod", "1/2/3/4/5/6/go.mod"))
    both = files(spark, [str(tmp_path), str(tmp_path / "vendor"), str(tmp_path / "a")]).collect()
    assert sorted(r.source for r in both) == sorted([*got, str(tmp_path / "vendor/go.mod")])
    several = files(spark, str(tmp_path / "*" / "go.mod")).collect()
    assert {r.source for r in several} >= {str(tmp_path / "a/go.mod"), str(tmp_path / "vendor/go.mod")}


def test_unusable_paths(spark, tmp_path):
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    for path in (str(tmp_path / "absent"), str(tmp_path / "gone"), "/dev/null"):
        with pytest.raises(Unusable):
            Engine(spark).read(path)


def test_joined_lines_are_linear(spark):
    text = "".join(f"p{i}==1.{i} \\\n    --hash=sha256:{i} \\\n    --hash=sha256:x{i}\n" for i in range(8000)) + "last \\"
    rows = requirements(spark.createDataFrame([("r", text), ("q", "a\nb\n")], "source string, text string")).orderBy("source", "line").collect()
    assert [(r.line, r.name) for r in rows if r.source == "q"] == [(1, "a"), (2, "b")]
    mine = [r for r in rows if r.source == "r"]
    assert len(mine) == 8001 and mine[5].name == "p5" and mine[5].line == 16 and mine[5].version == "1.5" and mine[5].has_integrity and mine[-1].name == "last"
