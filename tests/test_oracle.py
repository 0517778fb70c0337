"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest
from conftest import SF, TABLES

from tickloom.plans import edge_queries, io_queries, oracle, scale_queries
from tickloom.plans import queries as q

OTHERS = (io_queries, scale_queries, edge_queries)
QUERIES = {**q.queries(), **{k: v for m in OTHERS for k, v in m.queries().items()}}
SQL = {**oracle.SQL, **{k: v for m in OTHERS for k, v in m.SQL.items()}}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v) + 0.0, 5) if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    assert len(ours)


def test_json_extract(spark):
    found = q.json_extract(spark, SF).limit(5).collect()
    assert all(r["found"].startswith('{"k": ') for r in found)


def test_synthetic_bars_repeat(spark):
    a, b = (q.synthetic_bars(spark, SF).orderBy("ticker", "day").toPandas() for _ in range(2))
    assert len(a) == 25 * 60 and a.equals(b) and a["adjusted"].all() and (pd.to_datetime(a["day"]).dt.weekday < 5).all()
