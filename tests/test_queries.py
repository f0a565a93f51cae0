"""Every registered query of the relational part against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

from lattica.plans import registry
from lattica.session import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def text(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return "~" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    if name in registry.oracle_sql():
        found = duck.sql(registry.oracle_sql()[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
    else:
        assert rows
