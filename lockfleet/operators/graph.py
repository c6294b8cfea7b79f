"""Degrees, parents, reachability, and ordered walks of dependency graphs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockfleet.functions.text import version_order
from lockfleet.storage import drop, drop_path, shared_dir, written


def in_degree(edges: DataFrame) -> DataFrame:
    """``(source, idx, in_degree)`` of what has parents; repeated edges count."""
    return edges.groupBy("source", F.col("to_idx").alias("idx")).agg(F.count("*").alias("in_degree"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", F.col("from_idx").alias("idx")).agg(F.count("*").alias("out_degree"))


def parents(edges: DataFrame, packages: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(source, idx, parent_idx, parent)``: different parents of each package; ``tasks`` tells to how many tasks edges are dealt, where that is known."""
    p = packages.select("source", F.col("idx").alias("parent_idx"), F.col("name").alias("parent"))
    kin = edges.select("source", F.col("to_idx").alias("idx"), F.col("from_idx").alias("parent_idx"))
    # dealt by what they are joined on, so that the distinct rows needn't be dealt once more
    kin = kin.repartition(tasks, "source", "parent_idx") if tasks else kin
    return kin.distinct().join(p, ["source", "parent_idx"]).select("source", "idx", "parent_idx", "parent")


def place(packages: DataFrame):
    """The sort key of packages within a file: name, version, key, place."""
    return F.struct("name", version_order(F.col("version")).alias("v"), "key", "idx")


#: Starts whose closures are followed together, and so many of them share a number's bits.
TOGETHER, BITS = 2048, 64
#: Edges that a task is dealt, rows of steps that a bucket takes, and edges that are followed at once.
SHARE, BUCKET, AT_ONCE = 500_000, 1 << 18, 1 << 15


def _bucketed(rows: DataFrame, name: str, buckets: int) -> str:
    """A table of ``rows(grp, ...)`` in the shared folder, dealt by ``grp``: what joins and groups such tables by ``grp`` and more needs no shuffle."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (grp) INTO {buckets} BUCKETS LOCATION '{shared_dir(spark)}/{table}'")
    _append(rows.repartition(buckets, "grp"), table)
    return table


def _append(rows: DataFrame, table: str) -> None:
    rows.write.insertInto(table)
    rows.sparkSession.catalog.refreshTable(table)


def _numbered(starts: DataFrame) -> DataFrame:
    """``(source, start, part, n)``: starts numbered within parts of their source; a part is no more than a task's share."""
    dealt = written(starts.select("source", "start").distinct().repartitionByRange("source", "start").withColumn("part", F.spark_partition_id()), "starts")
    return dealt.withColumn("n", F.row_number().over(Window.partitionBy("source", "part").orderBy("start")) - 1)


def _followed_by_bits(starts: pa.Table, steps: pa.Table, depth: int | None) -> pa.Table:
    """``(grp, idx, depth, word, bits)``: what one group's ``starts(grp, word, bit, start)`` reach first in each round, the first aside, over ``steps(grp, idx, to_idx)``.

    A node has a row of words, with a bit for each start. A round takes the rows of the nodes that got new bits along their edges, and ors them by target.
    """
    n, e = starts.num_rows, steps.num_rows
    met = pa.chunked_array([*starts["start"].chunks, *steps["idx"].chunks, *steps["to_idx"].chunks], steps["to_idx"].type).combine_chunks().dictionary_encode(null_encoding="encode")
    code, names = met.indices.to_numpy(), met.dictionary
    begin, to = code[:n], code[n + e :]
    order = np.argsort(to, kind="stable")
    source, to = code[n : n + e][order], to[order]
    word, bit = starts["word"].to_numpy(), starts["bit"].to_numpy()
    words = int(word.max()) + 1 if n else 1
    front = np.zeros((len(names), words), np.uint64)
    np.bitwise_or.at(front, (begin, word), np.uint64(1) << bit.astype(np.uint64))
    seen, active = front.copy(), front.any(1)
    found, rounds = [], 0
    while e and rounds != depth:
        rounds += 1
        on = np.flatnonzero(active[source])
        targets, at = np.unique(to[on], return_inverse=True)
        new = np.zeros((len(targets), words), np.uint64)
        for i in range(0, len(on), AT_ONCE):
            part = at[i : i + AT_ONCE]
            heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            new[part[heads]] |= np.bitwise_or.reduceat(front[source[on[i : i + AT_ONCE]]], heads, axis=0)
        new &= ~seen[targets]
        some = new.any(1)
        targets, new = targets[some], new[some]
        if not len(targets):
            break
        seen[targets] |= new
        front[targets] = new
        active[:] = False
        active[targets] = True
        bits = pa.ListArray.from_arrays(np.arange(0, new.size + 1, words, dtype=np.int32), new.view(np.int64).ravel())
        found.append(pa.table({"grp": pa.array(np.full(len(targets), starts["grp"][0].as_py(), np.int64)), "idx": names.take(pa.array(targets)), "depth": pa.array(np.full(len(targets), rounds, np.int32)), "word": pa.array(np.zeros(len(targets), np.int32)), "bits": bits}))
    empty = pa.schema([("grp", pa.int64()), ("idx", names.type), ("depth", pa.int32()), ("word", pa.int32()), ("bits", pa.list_(pa.int64()))]).empty_table()
    return pa.concat_tables([t.cast(empty.schema) for t in found]) if found else empty


def reachable(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``(source, start, idx, depth)``: what each of ``starts(source, start)`` reaches, and in how many steps at least.

    The result is quadratic by nature, what leads to it isn't kept so: a row holds what a group of 2,048 starts has reached at a node in a round, as bits. Groups have
    their own copy of the edges that begin where something ends or starts, are dealt once, and are followed each in a task of its own, to the end or for ``depth`` rounds. A task
    holds a lockfile's edges (some 40 bytes each) and 256 bytes thrice for a node, and none of the pairs: those are made as the result is read.
    """
    spark = edges.sparkSession
    place = _numbered(starts).withColumn("block", F.expr(f"n div {TOGETHER}")).withColumn("word", F.expr(f"n % {TOGETHER} div {BITS}").cast("int")).withColumn("bit", (F.col("n") % BITS).cast("int"))
    groups = written(place.select("source", "part", "block").distinct().withColumn("grp", F.monotonically_increasing_id()), "groups")
    place = written(place.join(groups, ["source", "part", "block"]).select("grp", "source", "word", "bit", "start"), "places")
    # dealt by what is joined on to as many tasks as there are shares of edges, and made distinct where they lie
    kind, tasks = edges.schema["to_idx"].dataType, edges.count() // SHARE + 1
    entered = edges.select("source", F.col("to_idx").alias("idx")).union(starts.select("source", "start")).repartition(tasks, "source", "idx").distinct()
    step = edges.select("source", F.col("from_idx").cast(kind).alias("idx"), "to_idx").repartition(tasks, "source", "idx")
    step = written(step.join(entered, ["source", "idx"], "left_semi").distinct(), "step")
    rows = step.groupBy("source").count().join(groups, "source").agg(F.sum("count")).first()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET + 1), 10_000)
    steps = _bucketed(step.join(groups, "source").select("grp", "idx", "to_idx"), "steps", buckets)
    drop(step)
    places = _bucketed(place.select("grp", "word", "bit", F.col("start").cast(kind).alias("start")), "places", buckets)
    reached = _bucketed(place.select("grp", F.col("start").cast(kind).alias("idx"), F.lit(0).alias("depth"), "word", F.array(F.expr("shiftleft(1L, bit)")).alias("bits")), "reached", buckets)
    both = spark.table(places).groupBy("grp").cogroup(spark.table(steps).groupBy("grp"))
    _append(both.applyInArrow(lambda x, y: _followed_by_bits(x, y, depth), spark.table(reached).schema), reached)
    for table in (steps, places):
        spark.sql(f"DROP TABLE {table}")
        drop_path(spark, f"{shared_dir(spark)}/{table}")
    words = place.groupBy("grp", "source", "word").agg(F.array_sort(F.collect_list(F.struct("bit", "start")))["start"].alias("starts"))
    words = words.groupBy("grp", "source").agg(F.array_sort(F.collect_list(F.struct("word", "starts")))["starts"].alias("starts"))
    met = spark.table(reached).join(spark.table(_bucketed(words, "words", buckets)), "grp").select("source", "idx", "depth", "starts", "word", F.posexplode("bits").alias("nth", "held")).where("held <> 0")
    met = met.select("source", "idx", "depth", "held", F.posexplode(F.get("starts", F.col("word") + F.col("nth"))).alias("bit", "start"))
    return met.where("shiftrightunsigned(held, bit) & 1 = 1").select("source", "start", "idx", "depth")


#: Hits whose walks share a copy of their lockfile's edges, and rows of a walk that leave a task together.
HITS, CHUNK = 2048, 1 << 13
_STEP = pa.struct([("seq", pa.int32()), ("depth", pa.int32()), ("idx", pa.int32()), ("stop", pa.int32()), ("hidden", pa.int32())])
#: What the numbers of stops say, from 1.
STOPS = ("cycle", "repeat", "depth")


def _walk(hit: int, ptr: np.ndarray, to: np.ndarray, limit: int, seen: bytearray) -> list[np.ndarray]:
    """Columns of the walk below one node, as in ``_STEP``: kids of node i are ``to[ptr[i]:ptr[i + 1]]``. ``seen`` is given back as it was.

    Nodes above the limit are taken one by one, by a stack; the kids at the limit, most of a walk, all at once.
    """
    shown, seq, expanded, path, on, n = [], 0, [hit], [hit], {hit}, np.diff(ptr)
    low = [(hit, 0, (hit,))] if limit == 1 else []
    stack = [] if limit == 1 else [iter(to[ptr[hit] : ptr[hit + 1]].tolist())]
    seen[hit] = 1
    while stack:
        depth = len(path)
        for kid in stack[-1]:
            seq += 1
            stop = 1 if kid in on else 2 if seen[kid] else 0
            shown.append((seq, depth, kid, stop, 0))
            if stop:
                continue
            seen[kid] = 1
            expanded.append(kid)
            if depth != limit - 1:
                path.append(kid)
                on.add(kid)
                stack.append(iter(to[ptr[kid] : ptr[kid + 1]].tolist()))
                break
            if n[kid]:
                low.append((kid, seq, (*path, kid)))
                seq += int(n[kid])
        else:
            stack.pop()
            on.discard(path.pop())
    for x in expanded:
        seen[x] = 0
    out = np.array(shown, np.int64).reshape(-1, 5).T
    if low:
        above, first = np.array([x[0] for x in low]), np.array([x[1] for x in low])
        nth = np.repeat(np.arange(len(low)), n[above])
        place = np.arange(len(nth)) - np.repeat(np.cumsum(n[above]) - n[above], n[above])
        kid = to[ptr[above][nth] + place]
        cycle = np.zeros(len(kid), bool)
        for nodes in np.array([x[2] for x in low]).T:
            cycle |= nodes[nth] == kid
        stop = np.where(cycle, 1, np.where(n[kid] > 0, 3, 0))
        out = np.concatenate([out, [first[nth] + 1 + place, np.full(len(kid), limit), kid, stop, np.where(stop == 3, n[kid], 0)]], axis=1)
    return list(out)


def _walked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """``(source, hit, steps)`` of rows that come by group, each group's edges ``(a, b)`` in the order of kids before its hits ``a``: a walk at a time, in chunks."""
    group, edges, graph = None, [], None
    for batch in batches:
        grp, kind, a, b = (batch.column(i).to_numpy() for i in range(4))
        heads = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])]) if len(grp) else []
        for i, j in zip(heads, [*heads[1:], len(grp)]):
            if grp[i] != group:
                group, edges, graph = grp[i], [], None
            if not kind[i]:
                edges.append((a[i:j].copy(), b[i:j].copy()))
                continue
            if graph is None:
                source, to = (np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int32),) * 2
                names, edges = np.unique(np.concatenate([source, to])), []
                ptr = np.searchsorted(source, names)
                graph = names, np.append(ptr, len(source)), np.searchsorted(names, to), bytearray(len(names))
            names, ptr, to, seen = graph
            for hit, where in zip(a[i:j].tolist(), batch.column(4).slice(i, j - i).to_pylist()):
                at = int(np.searchsorted(names, hit))
                if at == len(names) or names[at] != hit:
                    continue
                seq, depth, idx, stop, hidden = _walk(at, ptr, to, limit, seen)
                steps = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (seq, depth, names[idx], stop, hidden)], fields=list(_STEP))
                for k in range(0, len(steps), CHUNK):
                    part = steps.slice(k, CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([hit], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], names=["source", "hit", "steps"])


def walks(hits: DataFrame, packages: DataFrame, edges: DataFrame, limit: int = 3) -> DataFrame:
    """``(source, hit, seq, depth, idx, stop, hidden)``: the ordered walk below each of ``hits(source, hit)``, to ``limit`` levels (0: all).

    Kids go by name, version, key and place. A node that stands above itself is a "cycle"; one at the limit that has kids
    stops as "depth", with how many are ``hidden``; one whose kids are shown earlier is a "repeat". Packages are numbered in their order once for a lockfile; edges are dealt, by that
    number, to groups of 2,048 hits of a lockfile, and a task walks its hits one after another. It holds a lockfile's edges (some 40 bytes each) and one walk; no walk is shuffled or written.
    """
    spark = edges.sparkSession
    hits = hits.select("source", F.col("hit").cast("int").alias("start"))
    numbered = written(_numbered(hits).withColumn("block", F.expr(f"n div {HITS}")), "hits")
    groups = written(numbered.select("source", "part", "block").distinct().withColumn("grp", F.monotonically_increasing_id()), "groups")
    sources = groups.select("source").distinct()
    own = written(edges.join(sources, "source", "left_semi").select("source", F.col("from_idx").cast("int").alias("from_idx"), F.col("to_idx").cast("int").alias("to_idx")), "own")
    order = F.row_number().over(Window.partitionBy("source").orderBy(*[F.col(f"p.{c}") for c in ("name", "v", "key", "idx")]))
    ranks = written(packages.join(sources, "source", "left_semi").select("source", F.col("idx").cast("int").alias("to_idx"), place(packages).alias("p")).select("source", "to_idx", order.alias("nth")), "ranks")
    # what neither a hit nor an edge leads to is left out where edges were dealt by where they begin
    tasks = own.count() // SHARE + 1
    entered = own.select("source", F.col("to_idx").alias("from_idx")).union(numbered.select("source", "start")).repartition(tasks, "source", "from_idx").distinct()
    kids = own.repartition(tasks, "source", "from_idx").join(entered, ["source", "from_idx"], "left_semi")
    kids = written(kids.join(ranks, ["source", "to_idx"]).select("source", "from_idx", "to_idx", "nth"), "kids")
    rows = kids.groupBy("source").count().join(groups, "source").agg(F.sum("count")).first()[0] or 0
    drop(own)
    drop(ranks)
    dealt = kids.join(groups, "source").select("grp", F.lit(0).alias("kind"), F.col("from_idx").alias("a"), F.col("to_idx").alias("b"), F.lit(None).cast("string").alias("source"), "nth")
    asked = numbered.join(groups, ["source", "part", "block"]).select("grp", F.lit(1).alias("kind"), F.col("start").alias("a"), F.lit(0).alias("b"), "source", F.lit(0).alias("nth"))
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET + 1), 10_000)
    dealt = dealt.unionByName(asked).repartition(buckets, "grp").sortWithinPartitions("grp", "kind", "a", "nth").select("grp", "kind", "a", "b", "source")
    steps = dealt.mapInArrow(lambda batches: _walked(batches, limit), "source string, hit int, steps array<struct<seq int, depth int, idx int, stop int, hidden int>>")
    steps = steps.select("source", "hit", F.inline("steps"))
    return steps.withColumn("stop", F.get(F.array(F.lit(None).cast("string"), *map(F.lit, STOPS)), F.col("stop")))
