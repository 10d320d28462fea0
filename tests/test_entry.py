"""The driver's contract: every query runs and agrees with its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from orrery.plans import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    got, want = own.QUERIES[name](spark, SF).toPandas(), duck.sql(own.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.astype({c: float for c in got.columns if got[c].dtype.kind in "iuf"})), rows(want.astype({c: float for c in want.columns if want[c].dtype.kind in "iuf"}))
    assert a == b


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_training_shifts_fall_to_nothing(spark):
    got = own.QUERIES["kmeans_converged"](spark, SF).orderBy("round").collect()
    assert got[-1].shift < got[0].shift and len(got) <= 25
