"""Every query against its SQL on the smallest tables."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from framelake import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        if pd.isna(v):
            return ""
        return str(int(v)) if isinstance(v, float) and not math.isinf(v) and v == int(v) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert os.path.exists(SF)
    assert set(entry.oracle_sql()) <= set(entry.queries())
