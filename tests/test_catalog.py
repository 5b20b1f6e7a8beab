"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from scanweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if (sql := catalog.oracle_sql().get(name)) is None:
        assert rows
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    assert rows == sorted(repr(tuple(r)) for r in found.select(*[f'"{c}"' for c in columns]).fetchall())
