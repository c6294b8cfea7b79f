"""Every query of this subpackage that has SQL is held against it, as the driver does."""

import glob
import os

import duckdb
import pytest

from lockfleet.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    cursor = tables.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(names) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want
