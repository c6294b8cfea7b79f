import json

from lockfleet.plans.engine import Engine
from lockfleet.streaming.changes import changes, compared
from lockfleet.streaming.landing import audits


def npm(**versions):
    packages = {f"node_modules/{n}": {"version": v, "hasInstallScript": n.startswith("s")} for n, v in versions.items()}
    return json.dumps({"lockfileVersion": 3, "packages": {"": {"dependencies": {n: "1" for n in versions}}, **packages}})


LANDINGS = [
    {"app/package-lock.json": npm(a="1.0.0", b="1.0.0", sx="1.0.0"), "lib/requirements.txt": "x>=1\ny==2\n"},
    {"app/package-lock.json": npm(a="2.0.0", c="1.0.0", sy="1.0.0"), "lib/requirements.txt": "x>=1\ny==2\n"},
    {"app/package-lock.json": "{not json", "lib/requirements.txt": "y==3\nz\n", "new/requirements.txt": "q\n"},
    {"app/package-lock.json": npm(a="2.0.0", sx="1.0.0"), "new/requirements.txt": "# nothing\n"},
]


def wanted(engine, old, new):
    """The sections of the engine's diff, as the stream tells them."""
    d = engine.diff(old, new)
    out = [(s, None, *r.identity.rsplit("@", 1), None) for s in ("added", "removed") for r in getattr(d, s).collect()]
    out += [("changed", None, r.name, r.to, r["from"]) for r in d.changed.collect()]
    out += [(s, r.rule, r.package, r.version, None) for s in ("introduced", "resolved") for r in getattr(d, s).collect()]
    d.release()
    return out


def test_replayed_landings_equal_diffs(spark, tmp_path):
    """Landings one by one and two at once; files that can't be read, that come later, that lose all they hold."""
    landing, out, corpus = tmp_path / "landing", tmp_path / "out", spark.createDataFrame([], "ecosystem string, name string")
    for n, files in enumerate(LANDINGS):
        for path, text in files.items():
            place = landing / f"day{n}" / path
            place.parent.mkdir(parents=True)
            place.write_text(text)
        if n == 2:
            continue  # the third and the fourth come together
        audits(spark, str(landing), str(out / "audited"), str(out / "ck1"), corpus, once=True).awaitTermination(120)
        changes(spark, str(out / "audited"), str(out / "changes"), str(out / "ck2"), once=True).awaitTermination(120)
    got = {}
    for r in spark.read.parquet(str(out / "changes")).collect():
        got.setdefault((r.landing, r.source), []).append((r.section, r.rule, r.package, r.version, r.was))
    app, lib, new = "app/package-lock.json", "lib/requirements.txt", "new/requirements.txt"
    one = lambda section, name, version, was=None: (section, None, name, version, was)
    want = {
        ("day1", app): wanted(Engine(spark), str(landing / "day0" / app), str(landing / "day1" / app)),
        ("day2", lib): [one("added", "y", "3"), one("added", "z", ""), one("removed", "x", ""), one("removed", "y", "2"), one("changed", "y", "3", "2"), ("introduced", "pinning", "z", "", None), ("resolved", "pinning", "x", "", None)],
        ("day3", app): [one("added", "sx", "1.0.0"), one("removed", "c", "1.0.0"), one("removed", "sy", "1.0.0"), ("introduced", "install-script", "sx", "1.0.0", None), ("resolved", "install-script", "sy", "1.0.0", None)],
        ("day3", new): [one("removed", "q", ""), ("resolved", "pinning", "q", "", None)],
    }
    for k in sorted(want.keys() | got.keys()):
        assert sorted(got.get(k, []), key=str) == sorted(want.get(k, []), key=str), k
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_same_state_changes_nothing():
    state = {("file", None, None, None, None, None), ("package", None, "a", "1", None, None), ("finding", "drift", "a", "", "medium", "x")}
    assert list(compared(state, state)) == [] and len(list(compared(set(), state))) == 2
