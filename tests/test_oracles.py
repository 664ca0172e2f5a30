"""Every registered query with SQL gives that SQL's rows."""

import os

import duckdb
import pandas as pd
import pytest

import tessera.plans  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(5)
        df[c] = df[c].map(lambda x: "" if x is None or x is pd.NaT or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got.toPandas()), canonical(want)
    for c in a.columns:  # integers that a null made floats
        if a[c].dtype == object and len(a) == len(b):
            a[c], b[c] = a[c].str.removesuffix(".0"), b[c].str.removesuffix(".0")
    a, b = a.sort_values(list(a.columns)).reset_index(drop=True), b.sort_values(list(b.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert len(a) or name in ()
