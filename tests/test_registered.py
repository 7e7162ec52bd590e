"""Every registered query against its SQL counterpart, over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracles import ORACLES

duckdb = pytest.importorskip("duckdb")
FOLDER = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert ORACLES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, connection, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    expected = connection.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(expected.column_names)

    def rows(table):
        return sorted(map(repr, zip(*[table[c].to_pylist() for c in columns])))

    assert rows(got) == rows(expected)
