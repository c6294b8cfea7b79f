import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from lockfleet.operators import diff, graph
from lockfleet.plans.engine import Engine


def packages(spark, rows):
    return spark.createDataFrame([("s", i, n, v, n + v, False) for i, (n, v) in enumerate(rows)], "source string, idx int, name string, version string, key string, first_party boolean")


def test_walks(spark):
    p = packages(spark, [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")])
    e = spark.createDataFrame([("s", 0, 2), ("s", 0, 1), ("s", 1, 3), ("s", 2, 3), ("s", 3, 0)], "source string, from_idx int, to_idx int")
    hit = spark.createDataFrame([("s", 0), ("s", 3)], "source string, hit int")
    rows = graph.walks(hit, p, e, 0).orderBy("hit", "seq").collect()
    assert [(r.depth, r.idx, r.stop) for r in rows if r.hit == 0] == [(1, 1, None), (2, 3, None), (3, 0, "cycle"), (1, 2, None), (2, 3, "repeat")]
    rows = graph.walks(hit, p, e, 1).where("hit = 0").orderBy("seq").collect()
    assert [(r.idx, r.stop, r.hidden) for r in rows] == [(1, "depth", 1), (2, "depth", 1)]


def plain_walk(kids, root, limit):
    """(depth, node, stop, kids hidden) in preorder, by one stack."""
    out, seen, path = [], {root}, [root]

    def go(node):
        for kid in kids.get(node, []):
            below = len(kids.get(kid, []))
            if kid in path:
                out.append((len(path), kid, "cycle", 0))
            elif limit and len(path) >= limit:
                out.append((len(path), kid, "depth" if below else None, below))
            elif kid in seen:
                out.append((len(path), kid, "repeat", 0))
            else:
                seen.add(kid)
                out.append((len(path), kid, None, 0))
                path.append(kid)
                go(kid)
                path.pop()

    go(root)
    return out


def test_walks_and_closure_of_many_graphs(spark):
    rng, graphs = random.Random(4), {}
    for n in range(30):
        size = rng.randrange(1, 9)
        graphs[f"s{n}"] = sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(0, 2 * size + 1))})
    p = spark.createDataFrame([(s, i, f"n{i}", "1.0.0", f"n{i}", False) for s in graphs for i in range(9)], "source string, idx int, name string, version string, key string, first_party boolean")
    e = spark.createDataFrame([(s, a, b) for s, edges in graphs.items() for a, b in edges], "source string, from_idx int, to_idx int")
    hits = spark.createDataFrame([(s, h) for s in graphs for h in (0, 1)], "source string, hit int")
    for limit in (0, 1, 3):
        got = {}
        for r in graph.walks(hits, p, e, limit).orderBy("source", "hit", "seq").collect():
            got.setdefault((r.source, r.hit), []).append((r.depth, r.idx, r.stop, r.hidden))
        for s, edges in graphs.items():
            kids = {a: [b for x, b in edges if x == a] for a, _ in edges}
            for h in (0, 1):
                assert got.get((s, h), []) == plain_walk(kids, h, limit), (edges, h, limit)
    near = {}
    for r in graph.reachable(e, hits.select("source", F.col("hit").alias("start"))).collect():
        near.setdefault((r.source, r.start), {})[r.idx] = r.depth
    for s, edges in graphs.items():
        for h in (0, 1):
            want, front = {h: 0}, [h]
            while front:
                front = [b for a, b in edges if a in front and b not in want and not want.update({b: want[a] + 1})]
            assert near[s, h] == want
    assert {r.depth for r in graph.reachable(e, hits.select("source", F.col("hit").alias("start")), 1).collect()} == {0, 1}
    assert graph.walks(hits.where("false"), p, e, 0).collect() == []


def test_diff_pads(spark):
    old, new = packages(spark, [("x", "1.0.0"), ("x", "2.0.0")]), packages(spark, [("x", "3.0.0")])
    assert sorted(map(tuple, diff.changed(old, new).collect())) == [("x", "1.0.0", "3.0.0"), ("x", "2.0.0", "—")]


def test_diff_json_and_stream(spark, tmp_path):
    for d, v in (("old", "==4.17.20"), ("new", "")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "requirements.txt").write_text(f"lodash{v}\n")
    moved = Engine(spark).diff(str(tmp_path / "old"), str(tmp_path / "new"))
    got = json.loads("".join(moved.json()))
    assert got["added"] == ["lodash@"] and got["removed"] == ["lodash@4.17.20"] and got["changed"] == [{"name": "lodash", "from": "4.17.20", "to": ""}]
    assert [f["rule"] for f in got["introduced"]] == ["pinning"] and got["resolved"] == []
    lines = list(moved.human())
    assert lines[3:8] == ["  added       1", "     lodash@", "", "  removed     1", "     lodash@4.17.20"] and "     lodash                   4.17.20 -> " in lines
    assert "  introduced  1 finding" in lines and lines[-2].startswith("     lodash                   no bound") and "  this change introduced no findings" not in lines
    from lockfleet.streaming.landing import audits

    corpus = spark.createDataFrame([], "ecosystem string, name string")
    for d in ("node_modules/x", ".hid"):  # what discovery doesn't enter, the stream doesn't read
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "requirements.txt").write_text("loose\n")
    q = audits(spark, str(tmp_path), str(tmp_path / "out"), str(tmp_path / "ck"), corpus, once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/findings")).count() == 1


def test_report_for_people(spark, tmp_path):
    (tmp_path / "requirements.txt").write_text("a==1\nb\n")
    text = Engine(spark).scan(str(tmp_path)).human(verbose=True).first()["text"]
    assert "2 packages   (2 direct · 0 transitive)" in text and "UNPINNED               1     no exact version recorded" in text and "risk 52/100" in text


def test_tree_json(spark, tmp_path):
    (tmp_path / "package-lock.json").write_text('{"lockfileVersion":3,"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1.0.0","dependencies":{"b":"1"}},"node_modules/b":{"version":"2.0.0","dependencies":{"a":"1","c":"1"}},"node_modules/c":{"version":"3.0.0","dependencies":{"a":"1"}}}}')
    e = Engine(spark)
    got = json.loads(e.tree_json(str(tmp_path), "A", 2))
    one = got["occurrences"][0]
    assert (got["found"], got["lockfiles"], got["near"]) == (True, 1, []) and (one["in_degree"], one["direct"]) == (2, True)
    assert [p["name"] for p in one["parents"]] == ["b", "c"]
    assert one["dependencies"] == [{"name": "b", "version": "2.0.0", "dependencies": [{"name": "a", "version": "1.0.0", "stop": "cycle", "dependencies": []}, {"name": "c", "version": "3.0.0", "stop": "depth", "hidden": 1, "dependencies": []}]}]
    lost = json.loads(e.tree_json(str(tmp_path), "bb"))
    assert not lost["found"] and [n["name"] for n in lost["near"]] == ["b", "a", "c"]


def test_diff_forms():
    from lockfleet.operators import console, report

    none = [(s, 0, iter([])) for s in report.SECTIONS]
    assert list(console.diff("a\x1b", "b", none))[1:] == ["  a\ufffd -> b", "", "  no change to the dependency tree"] and list(console.diff("a", "b", none, True)) == []
    some = [("added", 1200, iter(["x@1"])), ("introduced", 0, iter([])), ("resolved", 2, iter(["y", "z"]))]
    assert list(console.diff("a", "b", some, True)) == ["  added       1,200", "     x@1", "", "  resolved    2 findings", "     y", "     z", ""]
    assert json.loads("".join(report.diff_json('a"', "b", lambda s: iter(["1", "2"] if s == "added" else [])))) == {"old": 'a"', "new": "b", "added": [1, 2], "removed": [], "changed": [], "introduced": [], "resolved": []}


def test_tree_for_people(spark, tmp_path):
    (tmp_path / "package-lock.json").write_text('{"lockfileVersion":3,"packages":{"":{"dependencies":{"a":"1"}},"node_modules/a":{"version":"1.0.0","dependencies":{"b":"1","c":"1"}},"node_modules/b":{"version":"2.0.0","dev":true,"dependencies":{"a":"1","c":"1"}},"node_modules/c":{"version":"3.0.0","dependencies":{"d":"1"}},"node_modules/d":{"version":"4.0.0"}}}')
    (tmp_path / "requirements.txt").write_text("a==1\n")
    e, at = Engine(spark), str(tmp_path)
    lines = list(e.tree_text(at, "a"))
    assert f"  {at}/package-lock.json   npm · 4 packages" in lines and "  a@1.0.0   node_modules/a" in lines
    cut = lines.index("     depended on by   in-degree 1")
    assert lines[cut + 1 : cut + 10] == ["                      b@2.0.0", "", "     depends on       2 direct, to depth 3", "     ├─ b@2.0.0", "     │  ├─ a@1.0.0 · cycle, stands above", "     │  └─ c@3.0.0", "     │     └─ d@4.0.0", "     └─ c@3.0.0 (*)", "     (*) already expanded above"]
    assert "     flat format      no graph in this file" in lines


def test_tree_forms():
    from lockfleet.operators import console

    leaf = lambda n, **k: {"name": n, "version": "1", "dependencies": []} | k
    one = {"source": "s", "ecosystem": "npm", "name": "b", "version": "2", "key": "b@2", "dev": True, "optional": True, "first_party": False, "direct": False, "records_edges": True, "in_degree": 2, "packages": 1234}
    one |= {"parents": [{"name": "p", "version": "1", "key": "x/p"}, {"name": "p", "version": "1", "key": "y/p"}], "dependencies": [leaf("c", stop="depth", hidden=1)]}
    found = {"query": "b", "found": True, "lockfiles": 1, "depth": 1, "occurrences": [one], "near": []}
    lines = list(console.tree(found, "here", quiet=True))
    assert lines == ["", "  b@2", "     dev-only · optional", "", "     depended on by   in-degree 2", "                      p@1   x/p", "                      p@1   y/p", "", "     depends on       1 direct, to depth 1", "     └─ c@1 · 1 more below depth 1", ""]
    assert list(console.tree(found, "here"))[1] == "  s   npm · 1,234 packages"
    own = one | {"first_party": True, "in_degree": 0, "parents": [], "dependencies": []}
    lines = list(console.tree(found | {"occurrences": [own], "depth": 0}, "here"))
    assert "     workspace member" in lines and "     depended on by   in-degree 0" in lines and "     depends on       nothing" in lines
    near = [{"name": "bb", "distance": 1, "source": "s"}]
    lost = list(console.tree(found | {"occurrences": [], "lockfiles": 2, "near": near}, "here"))
    assert lost[1] == "  no package named `b` in the 2 lockfiles under here" and lost[4] == "     bb                       d=1 · s"
    assert "  no name is close to it either" in list(console.tree(found | {"occurrences": []}, "here"))


def test_quoted(spark):
    from pyspark.sql import functions as F

    from lockfleet.operators.report import quoted

    texts = ["", "a", 'q"\\/', "\n\r\t", "\x00\x01é\x1f\b\f😀", "\x7f\u2028"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(quoted(F.col("t"))).collect()]
    assert [json.loads(x) for x in got] == texts and got[4] == '"\\u0000\\u0001é\\u001f\\u0008\\u000c😀"'


def test_quiet_report(spark, tmp_path):
    (tmp_path / "requirements.txt").write_text("a==1\nb\n")
    text = Engine(spark).scan(str(tmp_path)).human(verbose=True, quiet=True).first()["text"]
    assert text.startswith("  ⚠  UNPINNED") and "risk" not in text and "packages" not in text


def test_blind_spots():
    from lockfleet.plans.engine import blind_spots
    from lockfleet.sources.lockfiles import Listing

    seen = Listing([], ["/x"], ["go.sum"], [("/y", "hidden")])
    assert blind_spots(seen) == '{"unreadable":["/x"],"unsupported":["go.sum"]}' and blind_spots(Listing([], [], [], [])) == ""
    assert blind_spots(seen, quiet=True) == '{"unreadable":["/x"],"unsupported":[]}' and "not descended" not in blind_spots(seen, False, True, True)
    assert "not descended into (1)" in blind_spots(seen, False, True)


def test_closure_keeps_words_of_starts_not_pairs(spark, monkeypatch):
    """What a closure writes grows by a row for 64 starts, and a round shuffles nothing but what it may broadcast."""
    ring = spark.range(200).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("from_idx"), F.explode(F.array(*[((F.col("id") * 7 + k) % 200).cast("int") for k in range(5)])).alias("to_idx"))
    rows, old = [], graph._append

    def append(df, table):
        old(df, table)
        rows.append((table.split("_")[0], df))

    monkeypatch.setattr(graph, "_append", append)
    got = graph.reachable(ring, ring.select("source", F.col("from_idx").alias("start")))
    assert got.count() == got.distinct().count() == 200 * 200
    rounds = [df for name, df in rows if name == "reached"]
    assert sum(df.count() for df in rounds[:1]) == 200
    assert "Exchange hashpartitioning" not in rounds[1]._jdf.queryExecution().executedPlan().toString()
    stored = next(t for t in spark.catalog.listTables() if t.name.startswith("reached_"))
    assert spark.table(stored.name).count() < 200 * 200 / 4


def test_walks_number_no_rows_at_the_limit(spark):
    p = packages(spark, [(f"n{i}", "1") for i in range(41)])
    e = spark.range(1, 41).select(F.lit("s").alias("source"), F.lit(0).alias("from_idx"), F.col("id").cast("int").alias("to_idx"))
    hit = spark.createDataFrame([("s", 0)], "source string, hit int")
    got = graph.walks(hit, p, e, 1)
    assert got.count() == 40 and sorted(r.seq for r in got.collect()) == list(range(1, 41))
    shown = got.queryExecution if hasattr(got, "queryExecution") else got._jdf.queryExecution()
    assert "Window" not in shown.optimizedPlan().toString()


def test_closure_writes_no_oftener_for_deeper_graphs(spark, monkeypatch):
    """A path of 40 nodes takes 40 rounds; they are followed in one pass, where the group of starts lies."""
    path = spark.range(40).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("from_idx"), (F.col("id") + 1).cast("int").alias("to_idx"))
    written, old = [], graph._append
    monkeypatch.setattr(graph, "_append", lambda df, table: (old(df, table), written.append(table.split("_")[0])))
    got = graph.reachable(path, path.select("source", F.col("from_idx").alias("start")))
    assert sorted((r.start, r.idx, r.depth) for r in got.collect()) == [(a, b, b - a) for a in range(40) for b in range(a, 41)]
    assert written.count("reached") == 2


def test_bits_of_starts_are_followed_in_parts(monkeypatch):
    """Words beyond the first, targets whose edges are in several parts, and a node without a number."""
    monkeypatch.setattr(graph, "AT_ONCE", 3)
    rng = random.Random(5)
    edges = sorted({(rng.randrange(100), rng.randrange(100)) for _ in range(160)} | {(i, 7) for i in range(20)}) + [(3, None)]
    starts = pa.table({"grp": pa.array([4] * 100, pa.int64()), "word": pa.array([i // 64 for i in range(100)], pa.int32()), "bit": pa.array([i % 64 for i in range(100)], pa.int32()), "start": pa.array(range(100), pa.int32())})
    steps = pa.table({"grp": pa.array([4] * len(edges), pa.int64()), "idx": pa.array([a for a, _ in edges], pa.int32()), "to_idx": pa.array([b for _, b in edges], pa.int32())})
    for depth in (None, 2, 0):
        got = {(64 * w + b, r["idx"], r["depth"]) for r in graph._followed_by_bits(starts, steps, depth).to_pylist() for w, held in enumerate(r["bits"]) for b in range(64) if held >> b & 1}
        want = set()
        for s in range(100):
            near, front = {s: 0}, [s]
            while front and near[front[0]] != depth:
                front = [b for a, b in dict.fromkeys((a, b) for x in front for a, b in edges if a == x) if b not in near and not near.update({b: near[a] + 1})]
            want |= {(s, b, d) for b, d in near.items() if d}
        assert got == want


def test_walks_write_no_walk(spark, monkeypatch):
    """A path of 20 nodes takes 20 levels; what is written before they are walked is the lockfile's edges, packages and hits, each once."""
    p = packages(spark, [(f"n{i:02}", "1") for i in range(20)])
    e = spark.range(19).select(F.lit("s").alias("source"), F.col("id").cast("int").alias("from_idx"), (F.col("id") + 1).cast("int").alias("to_idx"))
    held, old = {}, graph.written

    def written(df, name):
        assert name not in held
        held[name] = old(df, name)
        return held[name]

    monkeypatch.setattr(graph, "written", written)
    hit = spark.createDataFrame([("s", h) for h in range(10)], "source string, hit int")
    got = graph.walks(hit, p, e, 0)
    assert sorted((r.hit, r.seq, r.depth, r.idx) for r in got.collect()) == [(h, d, d, h + d) for h in range(10) for d in range(1, 20 - h)]
    assert max(held["kids"].count(), held["hits"].count()) <= 19


def test_walks_of_groups_in_pieces(monkeypatch):
    """Groups over several batches, walks over several chunks, repeated edges, hits without edges; all limits."""
    monkeypatch.setattr(graph, "CHUNK", 3)
    rng, graphs, rows = random.Random(6), [], []
    for n in range(12):
        graphs.append(sorted((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(0, 25))))
        rows += [(n, 0, a, b, None) for a, b in graphs[-1]] + [(n, 1, h, 0, f"s{n}") for h in range(9)]
    names = ["grp", "kind", "a", "b", "source"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    table = pa.table({c: pa.array(x, t) for c, x, t in zip(names, zip(*rows), types)})
    for limit in range(5):
        got = {}
        for batch in graph._walked(iter(table.to_batches(max_chunksize=7)), limit):
            for r in batch.to_pylist():
                got.setdefault((r["source"], r["hit"]), []).extend((x["seq"], x["depth"], x["idx"], (None, *graph.STOPS)[x["stop"]], x["hidden"]) for x in r["steps"])
        for n, edges in enumerate(graphs):
            kids = {a: [b for x, b in edges if x == a] for a, _ in edges}
            for h in range(9):
                assert sorted(got.get((f"s{n}", h), [])) == [(i, *x) for i, x in enumerate(plain_walk(kids, h, limit), 1)], (edges, h, limit)
