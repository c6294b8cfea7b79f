import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lockfleet.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """The same in plain Python: every part against every entry."""
    rows = [(i, [math.floor(1024 * x) for x in v], z) for i, v, z in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    m = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * m : (p + 1) * m]
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            sums = {}
            for _, v, _ in rows:
                sums.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for i, own in sums.items():
                book[i] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    done = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], z) for i, v, z in rows]
    total = {}
    for _, got, z in done:
        total[z] = total.get(z, 0) + sum(d for d, _ in got)
    return sorted(((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), total[z], sha) for i, got, z in done), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_equals_the_plain_form(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8) * rng.choice([0.01, 1, 30]))], int(i % 3) if i % 7 else None) for i in rng.permutation(400)]
    assert rows_of(V.report(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_nulls_repeats_ties_few_rows_and_clashes(spark):
    v = [0.5, -0.25, 1.0, 0.0]
    rows = [(None, v, None), (2, v, 1), (2, v, 1), (2, [9.0, 9.0, 9.0, 9.0], 1), (1, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [float("nan")] * 4, 1), (5, [float("-inf"), 0.0, 0.0, 0.0], 1), (6, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(V.report(df)) == plain(rows)
    clash = df.withColumnsRenamed({"label": "Code"}).selectExpr("*", "1 AS error", "'x' AS rows", "2 AS part")
    books = V.fitted(V.kept(df))
    out = V.encoded(V.kept(clash), books)
    assert out.columns == ["vec_id", "embedding", "Code", "error", "rows", "part", "_code", "_error"] and out.count() == 5
    back = V.decoded(out, books, "_code", "embedding")
    assert back.columns[-1] == "_embedding" and {tuple(r["_embedding"]) for r in back.where("vec_id = 6").collect()} == {(0.0,) * 4}
    assert V.report(df.selectExpr("*", "'a' AS code", "1 AS error", "1 AS label_error")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_empty_tables_and_unequal_lengths(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.report(none).collect() == [] and V.fitted(none) is None and V.encoded(none, None).collect() == []
    assert rows_of(V.report(spark.createDataFrame([(1, [], 1)], SCHEMA))) == plain([(1, [], 1)])
    with pytest.raises(Exception, match="another length"):
        V.report(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA)).collect()
    with pytest.raises(ValueError, match="equal parts"):
        V.report(spark.createDataFrame([(1, [1.0] * 3, 1)], SCHEMA))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_annulus_holds_the_nearest(data):
    size = data.draw(st.sampled_from([3, 40, 30_000, 1 << 24, 1 << 31]))
    number = st.integers(-size, size - 1)
    width = data.draw(st.integers(1, 4))
    some = lambda n: st.lists(st.lists(number, min_size=width, max_size=width), min_size=1, max_size=n)
    book, parts = np.array(data.draw(some(60)), np.int64), np.array(data.draw(some(30)), np.int64)
    best = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book)) for x in parts]
    if max(best)[0] < 1 << 63:
        index, error = V.Ring(book).nearest(parts)
        assert list(zip(error.tolist(), index.tolist())) == best


def test_only_the_annulus_is_compared():
    rng = np.random.default_rng(0)
    book = (rng.normal(size=(256, 16)) * np.linspace(1, 400, 256)[:, None]).astype(np.int64)
    ring = V.Ring(book)
    ring.nearest(np.repeat(book, 20, axis=0))
    assert ring.compared < 256 * 20 * 256 / 3


def test_floors_go_down():
    assert V.integers(pa.array([[-0.0001, 0.0009]]), 2).tolist() == [[-1, 0]]
