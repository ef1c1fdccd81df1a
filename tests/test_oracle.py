"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest
from conftest import DATA

from checks.oracle import ORACLE_SQL
from checks.queries import INPUT_TABLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in INPUT_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in places) for r in cursor.fetchall()), key=repr)
    assert got, "no rows to compare"
    assert got == want
