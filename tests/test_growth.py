"""Keys beyond those of the smallest tables: results that only larger tables show."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pytest

from tidewater.functions import features as X
from tidewater.operators import folds, fusion
from tidewater.plans import flow_oracle, flow_queries, model_oracle, model_queries

QUERIES = flow_queries.QUERIES | model_queries.QUERIES
ORACLE = flow_oracle.ORACLE | model_oracle.ORACLE


@pytest.fixture(scope="module")
def shifted(small, tmp_path_factory):
    """The events of the smallest tables and copies with shifted keys."""
    folder = tmp_path_factory.mktemp("shifted")
    con = duckdb.connect()

    def make(shifts: list[tuple[int, int]]) -> tuple[str, duckdb.DuckDBPyConnection]:
        rows = ", ".join(f"({e}, {u})" for e, u in shifts)
        con.sql(f"COPY (SELECT event_id + e AS event_id, ts, user_id + u AS user_id, event_type, value, props FROM '{small}/events.parquet', (VALUES {rows}) v(e, u)) TO '{folder}/events.parquet'")
        con.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        return str(folder), con

    return make


def same(spark, made, name):
    folder, con = made
    df, want = QUERIES[name](spark, folder), con.sql(ORACLE[name])
    at = sorted(df.columns)
    assert sorted(want.columns) == at
    got, right = df.select(at).collect(), con.sql(f"SELECT {', '.join(at)} FROM ({ORACLE[name]}) q").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(right, key=str)
    return got


def test_netflow_of_many_sources_and_late_clocks(spark, shifted):
    made = shifted([(0, 0), (10**6, 90_000), (10**9, 70_000)])
    got = same(spark, made, "netflow_decode")
    assert any(r.src_ip.split(".")[2] == "360" for r in got)


def test_a_question_from_a_port_that_amplifiers_share_is_no_reflection(spark, shifted, small):
    user = duckdb.sql(f"SELECT user_id FROM '{small}/events.parquet' WHERE event_type = 'signup' ORDER BY value DESC LIMIT 1").fetchall()[0][0]
    made = shifted([(0, 1900 - 1024 - user)])
    folder, con = made
    most = con.sql("SELECT max(floor(value*100)/(CAST(json_extract_string(props,'$.k') AS INT)+1)) FROM events WHERE event_type='signup' AND 1024+user_id%60000=1900").fetchall()[0][0]
    assert most >= 600
    assert sum(r.udp for r in same(spark, made, "ddos_windows")) > 0


def test_no_task_of_a_chain_sorts_more_than_a_part(spark, shifted, monkeypatch):
    made = shifted([(0, 0), (10**6, 1500), (2 * 10**6, 3000)])
    most, dealt = [], folds.discard
    monkeypatch.setattr(folds, "ROWS", 250)
    monkeypatch.setattr(folds, "discard", lambda t: (most.append(t.groupBy("_part").count().agg({"count": "max"}).first()[0]) if "_part" in t.columns else None, dealt(t)))
    rows = same(spark, made, "ledger_chain")
    assert len(rows) > 1000 and most and max(most) <= 500
    same(spark, made, "ledger_verify")
    assert tuple(fusion.resume(QUERIES["ledger_chain"](spark, made[0])).first())[0] == len(rows)


def test_verdicts_do_not_depend_on_the_parts_of_the_pass(spark, shifted, monkeypatch):
    folder, _ = shifted([(0, 0), (10**6, 1500), (2 * 10**6, 3000)])
    whole = sorted(map(tuple, QUERIES["anomaly_hits_exact"](spark, folder).collect()))
    monkeypatch.setattr(folds, "ROWS", 250)
    parts, dealt = [], folds.discard
    monkeypatch.setattr(folds, "discard", lambda t: (parts.append(t.select("_part").distinct().count()) if "_part" in t.columns else None, dealt(t)))
    assert sorted(map(tuple, QUERIES["anomaly_hits_exact"](spark, folder).collect())) == whole and whole
    assert parts and parts[0] > 3


def test_volumes_are_joined_once(spark, small):
    """Neither the windows' origin nor the hosts seen so far, which only named flows need, read and join all lines again."""
    plan = QUERIES["exfil_windows"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # lineitem, orders, and lineitem for the one row of the origin


def test_autocorrelation_of_a_long_array_costs_no_square(spark):
    x = np.random.default_rng(5).normal(size=40_000) + np.tile(np.arange(8.0), 5_000)
    d = x - x.mean()
    began = time.time()
    got = spark.createDataFrame([(x.tolist(),), (x[:700].tolist(),), (None,)], "xs array<double>").select(X.autocorrelation_peak("xs").alias("peak")).collect()
    assert time.time() - began < 15
    e = x[:700] - x[:700].mean()
    assert got[0].peak == pytest.approx(max(d[k:] @ d[:-k] for k in range(8, 800, 8)) / (d @ d), abs=1e-9)
    assert got[1].peak == pytest.approx(max(e[k:] @ e[:-k] for k in range(1, 351)) / (e @ e), abs=1e-9) and got[2].peak is None
