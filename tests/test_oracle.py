"""Every query with a SQL twin agrees with DuckDB, every other query gives rows, and no
plan holds a cross join, a row-at-a-time Python function or a window over a whole table."""

import pytest
from oracle import ROOT, compare, connect
from plans import findings

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = str(ROOT / "sf0.001")
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare(con, df, ORACLE[name]) is None
    assert findings(df) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0
    assert findings(df) == []


def test_entry(spark):
    assert entry(spark).count() > 0
