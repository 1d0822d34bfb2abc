"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def plain(row):
    return tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in row)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for file in os.listdir(sf):
        path = f"{sf}/{file}"
        c.sql(f"create view {file.split('.')[0]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    order = [want.columns.index(c) for c in columns]
    expected = sorted((plain([r[i] for i in order]) for r in want.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("size", [50, 46, 7, None])
def test_outgoing_edges_of_a_forbidden_cell(spark, tmp_path, size):
    """None in SQL where the cell itself is forbidden or has no value."""
    rows = [(k, size if k == 75 else k % 9 + 1) for k in range(150)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = QUERIES["outgoing_edges"](spark, str(tmp_path)).select("u", "v", "w").collect()
    want = c.sql(f"select u, v, w from ({SQL['outgoing_edges']})").fetchall()
    assert sorted(map(plain, got)) == sorted(map(plain, want)) and len(want) == (8 if size == 7 else 0)
