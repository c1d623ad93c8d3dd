"""Every query with SQL against DuckDB on the smallest tables."""

import collections
import glob
import os

import pytest

from wardloom.plans import catalogue, problems

DIR = os.environ.get("WARDLOOM_TEST_TABLES", "/root/testdata/sf0.001")
QUERIES = problems.QUERIES | catalogue.QUERIES
ORACLE = problems.ORACLE | catalogue.ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return collections.Counter(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in ORACLE:
        assert columns
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry_names_agree():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names and set(entry.oracle_sql()) <= names
