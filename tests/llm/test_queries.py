"""Registered queries on the driver's tables against their SQL, and the rest for shape."""

import duckdb
import pandas as pd
import pytest

from tessera.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def rows(df):
    return sorted(tuple("" if pd.isna(x) else repr(float(x)) if not isinstance(x, str) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(got) == 200 and got.iloc[:, 0].is_unique
        return
    expected = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
