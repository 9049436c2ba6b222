"""Every registered query of the engine against its DuckDB SQL at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera import queries


def normal(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in r:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append("NULL")
            elif hasattr(v, "dtype") and v.dtype.kind in "iuf" or isinstance(v, (int, float)) and not isinstance(v, bool):
                row.append(f"{float(v) + 0.0:.5f}".replace("-0.00000", "0.00000"))
            else:
                row.append(str(v))
        out.append(tuple(row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(queries.QUERIES) <= set(__spark_entry__.queries())
