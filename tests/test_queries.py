"""Every query of the engine's own operators against its SQL."""

import os

import duckdb
import pytest

from gaugeframe.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    return duckdb


@pytest.mark.parametrize("name", registry.QUERIES)
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(columns).collect())))
    assert got == sorted(map(repr, duck.sql(f"select {','.join(columns)} from ({registry.ORACLES[name]})").fetchall()))
