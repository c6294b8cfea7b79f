import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lockfleet.operators import graph, resolve, rules
from lockfleet.plans import embedding
from lockfleet.plans.embedding import SQL, fleet
from lockfleet.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_edges_are_made_distinct_once(spark):
    edges = fleet(spark, "/root/testdata/sf0.001").edges
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [p_partkey" in line]
    assert edges.count() == edges.distinct().count() > 0


def _tables(tmp_path, part: str, lineitem: str) -> str:
    """A folder with the smallest tables, changed by these selections of ``part`` and ``lineitem``."""
    con = duckdb.connect()
    for name, sql in (("part", part), ("lineitem", lineitem)):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


def _wanted(folder: str) -> list[tuple]:
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return sorted(con.execute(SQL + "SELECT source, from_idx, to_idx FROM edges").fetchall())


def test_a_task_takes_a_share_of_the_edges_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SHARE", 500)
    t = fleet(spark, SF)
    assert t.tasks == (t.part.count() + t.lineitem.count()) // 500 + 1 > 10
    dealt = t.edges.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 5 * 500
    kin = graph.parents(t.edges, t.packages, t.tasks)
    assert len(kin.select(F.spark_partition_id()).distinct().collect()) > 8
    plain = graph.parents(t.edges, t.packages)
    assert sorted(kin.collect()) == sorted(plain.collect())


@pytest.mark.parametrize(
    "part, lineitem",
    [
        ("SELECT * FROM part", "SELECT * FROM lineitem"),
        ("SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_partkey % 3 = 0", "SELECT * FROM lineitem"),  # keys repeat
        ("SELECT * REPLACE (p_partkey * 1000 AS p_partkey) FROM part", "SELECT * REPLACE (l_partkey * 1000 AS l_partkey) FROM lineitem"),  # many blocks, with gaps
        ("SELECT * REPLACE (p_partkey - 100 AS p_partkey) FROM part", "SELECT * REPLACE (l_partkey - 100 AS l_partkey) FROM lineitem"),  # keys below 0
        ("SELECT * REPLACE (CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS p_brand) FROM part", "SELECT * REPLACE (CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS l_suppkey) FROM lineitem"),
        ("SELECT * FROM part", "SELECT * FROM lineitem WHERE false"),
        ("SELECT * FROM part WHERE false", "SELECT * FROM lineitem"),
    ],
)
def test_edges_equal_the_sql(spark, tmp_path, part, lineitem):
    folder = _tables(tmp_path, part, lineitem)
    want = _wanted(folder)
    assert sorted(map(tuple, fleet(spark, folder).edges.collect())) == want
    assert sorted(map(tuple, fleet(spark, folder).outgoing.collect())) == [e[:2] for e in want]
    assert bool(want) == ("false" not in part + lineitem)


def test_hubs_are_numbered_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding, "BLOCK", 7)
    t = fleet(spark, SF)
    want = fleet(spark, SF).part.count()
    sizes, hubs = embedding._hubs(t.part, 4)
    got = hubs.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("hub").alias("d"), F.max("hub").alias("last")).join(sizes, "p_brand").collect()
    assert got and all(r["n"] == r["d"] == r["last"] + 1 == r["hubs"] for r in got) and sum(r["hubs"] for r in got) < want
    plan = hubs._jdf.queryExecution().optimizedPlan().toString()
    assert "[p_brand#" in plan and all("block" in line for line in plan.splitlines() if "Window [row_number" in line)


def test_edges_are_met_by_entries_once_for_each_target(spark):
    edges = spark.createDataFrame([("s", 1, 2)] * 50 + [("s", 3, 2)], "source string, from_idx int, to_idx int")
    entries = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "source string, idx int")
    got = resolve.without_parents(entries, edges)
    assert sorted(r["idx"] for r in got.collect()) == [1, 3]
    assert "Aggregate [source" in got._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_dealt_once_for_all_rules(spark):
    t = fleet(spark, SF)
    found = rules.audit(t.lockfiles, t.packages, t.edges, t.corpus)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = {re.sub(r"#\d+L?", "", x).strip(" +-:") for x in plan if "Filter" in x and "l_partkey" in x}
    assert filters == {"Filter isnotnull(l_partkey)"}, filters


def test_out_degrees_are_counted_where_line_items_were_dealt(spark):
    t = fleet(spark, SF)
    got = graph.out_degree(t.outgoing)
    assert sorted(got.collect()) == sorted(graph.out_degree(t.edges).collect())
    plan = QUERIES["out_degree"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("p_partkey") for line in plan.splitlines() if "RepartitionByExpression" in line] == [1]


@pytest.mark.parametrize("name", ["slopsquat", "slopsquat_no_parent", "decay_share", "out_degree"])
def test_a_query_deals_line_items_once_and_by_their_number(spark, monkeypatch, name):
    plain = QUERIES[name](spark, SF)
    monkeypatch.setattr(embedding, "SHARE", 500)
    got = QUERIES[name](spark, SF)
    if name != "decay_share":  # ten times the rule, so its plan alone is looked at
        want = sorted(plain.collect())
        assert want and sorted(got.collect()) == want
    plan = re.sub(r"#\d+L?", "", got._jdf.queryExecution().optimizedPlan().toString()).splitlines()
    below = {(plan[i - 1].strip(" +-:"), plan[i].strip(" +-:")) for i in range(len(plan)) if "Project [l_partkey" in plan[i]}
    assert below == {(f"RepartitionByExpression [p_partkey], {fleet(spark, SF).tasks}", "Project [l_partkey AS p_partkey, l_suppkey AS k]")}, below
