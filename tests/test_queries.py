"""Every query of the engine against its SQL in DuckDB, at sf0.001."""

from __future__ import annotations

import os

import pytest

from docquarry import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (int, bool)) else str(value)


def rows(names, found):
    order = sorted(names)
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = rows(df.columns, df.collect())
    assert found
    if name in catalog.oracle_sql():
        result = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows(names, result.fetchall())
