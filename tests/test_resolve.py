import re

from pyspark.sql import functions as F

from lockfleet.operators import resolve


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normalised_gathers_no_pairs(spark):
    names = spark.createDataFrame([("s", 0, "A_b", "1"), ("s", 1, "a.b", "2"), ("s", 2, "a-b", "2"), ("t", 3, "a-b", "1"), ("s", 4, "c", None)], "source string, idx int, name string, version string")
    refs = spark.createDataFrame([("s", 9, 0, "A-B", None), ("s", 8, 0, "a--b", "2"), ("s", 7, 0, "a-b", "7"), ("s", 7, 1, "C", "1"), ("t", 6, 0, "c", None)], "source string, ref int, nth int, name string, version string")
    got = resolve.normalised(refs, names)
    assert rows(got) == [("s", 7, 0), ("s", 7, 1), ("s", 7, 2), ("s", 7, 4), ("s", 8, 1), ("s", 9, 0), ("s", 9, 1), ("s", 9, 2)]
    assert "collect_list" not in plan(got)
    # pairs are results only: nothing is grouped or made distinct above the join that makes them
    assert not re.search(r"Aggregate", plan(got).split("Join", 1)[0])


def test_ranked_meets_one_name_a_reference(spark):
    many = [("s", i, "a", "1" if i % 2 else "2", "x" if i > 50 else None) for i in range(100)]
    names = spark.createDataFrame([*many, ("s", 200, "b", None, "x"), ("t", 201, "a", "1", "x")], "source string, idx int, name string, version string, src string")
    asked = [("a", "1", "x"), ("a", "1", None), ("a", "2", "y"), ("a", None, "x"), ("a", "3", "x"), ("b", None, None), ("b", "1", "x"), ("c", None, None)]
    refs = spark.createDataFrame([("s", 9, n, *a) for n, a in enumerate(asked)] + [("t", 8, 0, "a", "1", None)], "source string, ref int, nth int, name string, version string, src string")
    got = resolve.ranked(refs, names)
    assert rows(got) == [("s", 9, 0), ("s", 9, 0), ("s", 9, 1), ("s", 9, 51), ("s", 9, 200), ("t", 8, 201)]
    # names are grouped before they are met, and what is met isn't grouped again
    assert plan(got).count("Aggregate") == 3 and "Aggregate" not in plan(got).split("Join", 1)[0]
