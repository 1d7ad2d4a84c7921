"""One local session for all tests, and DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from vellum.session import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session(8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    return con


def plain(v):
    """A value in a form that compares alike whether Spark or DuckDB made it."""
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bytes | bytearray):
        return repr(bytes(v))
    return repr(v)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql: str) -> None:
        df = query(spark, sf)
        names = sorted(df.columns)
        found = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
        cursor = duck.execute(sql)
        order = [d[0] for d in cursor.description]
        assert sorted(order) == names
        wanted = sorted(tuple(plain(r[order.index(c)]) for c in names) for r in cursor.fetchall())
        assert found == wanted

    return check
