from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from tidewater.plans import flow_oracle, flow_queries, model_oracle, model_queries

QUERIES = flow_queries.QUERIES | model_queries.QUERIES
ORACLE = flow_oracle.ORACLE | model_oracle.ORACLE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"ranked_incidents", "anomaly_hits", "anomaly_hits_exact"}  # may have no row in the smallest tables


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    assert got or name in EMPTY
    if name in ORACLE:
        want = con.sql(ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(list(want.columns), want.fetchall())
