"""Every named query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from auditloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def text(value) -> str:
    if value is None or value != value:
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value).lower()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE])
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    have = sorted(tuple(text(r[c]) for c in columns) for r in got.collect())
    sql = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(dict(zip(names, r))[c]) for c in columns) for r in sql.fetchall())
    assert have == want


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE])
def test_query_without_sql(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    assert df.count() >= 0 and df.columns
