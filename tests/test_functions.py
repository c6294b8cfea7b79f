import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lockfleet.functions import text as T
from lockfleet.functions.distance import bounded, distance, distance_within
from lockfleet.operators.evaluation import states, thinned
from lockfleet.operators.report import score


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_distance_goldens():
    for a, b, d in [("", "", 0), ("abc", "abd", 1), ("ab", "ba", 1), ("CA", "ABC", 2), ("lodahs", "lodash", 1), ("expres", "express", 1), ("chalck", "chalk", 1)]:
        assert distance(a, b) == distance(b, a) == d


words = st.text("abc", max_size=6)


@settings(max_examples=200, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    assert (distance(a, b) == 0) == (a == b)
    assert distance(a, b) == distance(b, a)
    assert distance(a, c) <= distance(a, b) + distance(b, c)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=9), st.text("abcé", max_size=9)), max_size=30), st.integers(0, 4))
def test_bounded_distance_equals_the_whole_one(pairs, most):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    want = [d if (d := distance(x, y)) <= most else -1 for x, y in pairs]
    assert bounded(a, b, most).tolist() == want


def test_bounded_distance_of_columns(spark):
    rows = [("lodahs", "lodash", 1), ("CA", "ABC", 2), ("CA", "ABC", 1), ("x" * 5000, "x" * 5001, 2), (None, "a", 1), ("a", "a", None), ("", "", 0), ("😀b", "b😀", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, k int")
    got = [r[0] for r in df.orderBy("i").select(distance_within(F.col("a"), F.col("b"), F.col("k"))).collect()]
    assert got == [1, 2, None, 1, None, None, 0, 1]


def test_semver_order(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "v1.2", "1.10+build", "2", "1.2.3.4", "nope"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r[0] for r in df.orderBy(T.version_order(F.col("v"))).collect()] == order
    assert column(spark, ["1.2.3.4", "x", "", "1..2", None], T.semver) == [None] * 5


def test_names(spark):
    assert column(spark, ["Foo__Bar.-baz", "É"], lambda c: T.normalize(c, "pypi")) == ["foo-bar-baz", "É"]
    assert column(spark, ["Foo_Bar"], lambda c: T.normalize(c, "npm")) == ["foo_bar"]
    assert column(spark, ["a\x07b\x9fc"], T.scrub) == ["a�b�c"]
    assert column(spark, ["", "abcd", "abcde", "abcdefghi", "abcdefghij", "a" * 30], T.budget) == [0, 0, 1, 1, 2, 2]
    assert column(spark, ["ab", "abcdef"], lambda c: T.pad(c, 4)) == ["ab  ", "abcdef"]
    assert column(spark, [0, 999, 1000, 1234567], T.thousands, "long") == ["0", "999", "1,000", "1,234,567"]
    assert column(spark, ["HIGH", "low", "x"], T.severity_rank) == [3, 1, None]


def test_pins(spark):
    specs = [">=1.0", "~=1.2", "<2", "!=1.5", "", "==1.2.*", ">=1.0,<2", ">=1.0,==1.4", "!=1.5,!=1.6", ">=1.0,!=1.5", "@https://x/y", "===1.0", "=1", "==", ">=1,"]
    kinds = ["range", "compatible", "range", "unconstrained", "unconstrained", "compatible", "range", "exact", "unconstrained", "range", "unconstrained", "exact", None, None, None]
    got = column(spark, specs, T.pin)
    assert [g and g["kind"] for g in got] == kinds
    assert got[7]["version"] == "1.4" and got[11]["version"] == "1.0" and got[6]["spec"] == ">=1.0,<2"


def test_scores_keep_to_their_bands(spark):
    df = spark.createDataFrame([(w, n) for w in (1, 2, 3, 4) for n in (1, 2, 10, 100, 100_000)], "w int, n long")
    got = {(r[0], r[1]): r[2] for r in df.select("w", "n", score(F.col("w"), F.col("n"))).collect()}
    assert got[4, 1] == 77 and got[4, 2] == 79
    assert all(got[w, 100_000] < got[w + 1, 1] for w in (1, 2, 3))


def serial(count, seed):
    """The sequence that thins a corpus, one step after the other."""
    s, out, mask = seed | 1, [], (1 << 64) - 1
    for _ in range(count):
        s ^= (s << 13) & mask
        s ^= s >> 7
        s ^= (s << 17) & mask
        out.append(s)
    return out


def test_leaps_equal_steps():
    want = serial(3000, 0x5EED1234)
    places = np.random.default_rng(0).permutation(3000) + 1
    assert states(places, 0x5EED1234).tolist() == [want[i - 1] for i in places]
    far = states(np.array([10**12, 10**12 + 1, (1 << 62) + 5]), 7)
    s = int(far[0])
    s ^= (s << 13) & ((1 << 64) - 1)
    s ^= s >> 7
    assert int(far[1]) == s ^ (s << 17) & ((1 << 64) - 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_thinning_equals_the_serial_sequence(spark, parts):
    names = [f"n{i}" for i in range(500)] + ["é", "￮", "😀", "n7"]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(parts)
    draws = dict(zip(range(len(names)), (x % 1000 for x in serial(len(names), 0x5EED1234))))
    want = [n for i, n in enumerate(sorted(names, key=str.encode)) if draws[i] < 500]
    assert sorted(r[0] for r in thinned(df, 500, 0x5EED1234).collect()) == sorted(want)
    assert thinned(df, 1000, 1).count() == len(names) and thinned(df.where("false"), 500, 1).count() == 0


def test_percentages_round_by_their_exact_value(spark):
    from lockfleet.operators.report import percentage

    rows = [(h, n) for n in (1, 3, 7, 16, 40, 80, 2000, 999_983) for h in {0, 1, 3, 5, n // 7, n // 2, n - 1, n}] + [(h, 2000) for h in range(2001)]
    got = spark.createDataFrame(rows, "h long, n long").select("h", "n", percentage(F.col("h"), F.col("n")).alias("p")).collect()
    assert all(r.p == f"{100.0 * r.h / r.n:.1f}" for r in got)
