"""Every registered query against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in registry.TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def rows(df):
    def plain(x):
        if pd.isna(x):
            return ""
        return str(x) if isinstance(x, str) else str(pd.Timestamp(x)) if hasattr(x, "year") else repr(float(x))

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    if name not in registry.SQL:
        assert got.count() >= 1
        return
    got, expected = got.toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
