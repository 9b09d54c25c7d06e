"""Corpus queries with SQL twins on the smallest tables."""

import duckdb
import pytest

from lumenframe.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_twin(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.sql(registry.ORACLES[name]).df()
    keys = sorted(got.columns)
    assert keys == sorted(want.columns)
    got, want = (d[keys].sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert got.equals(want.astype(got.dtypes.to_dict()))


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))
