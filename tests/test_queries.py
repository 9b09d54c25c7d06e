"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import duckdb
import pandas as pd
import pytest

from lumenframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_twin(spark, sf, oracle, name):
    got, want = ordered(registry.QUERIES[name](spark, sf).toPandas()), ordered(oracle.sql(registry.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.count()
    assert df.columns and rows > 0 and all(t != "void" for _, t in df.dtypes)
