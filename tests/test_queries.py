"""Every registered query against its SQL on DuckDB."""

import duckdb
import pytest

from tessera import registry
from tessera.plans.base import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    return (0, "") if v is None else (1, round(float(v), 6)) if isinstance(v, int | float) else (2, str(v))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in rows)
    assert got == sorted(tuple(cell(r[want.columns.index(c)]) for c in names) for r in want.fetchall())
