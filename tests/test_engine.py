from __future__ import annotations

from pathlib import Path

import tidewater
from tidewater.__main__ import network_imports
from tidewater.operators import fusion as N
from tidewater.operators import windows as W
from tidewater.plans import engine
from tidewater.sources import synthetic
from tidewater.streaming import live


def test_engine_end_to_end(spark):
    flows = synthetic.flows(spark, 4000, duration=300.0, benign=0.6)
    got = engine.run(flows, engine.Config(width=60.0))
    made = got["alerts"].persist()
    alerts = made.collect()
    assert {"ics_intrusion"} <= {a.threat_class for a in alerts} and all(0 <= a.confidence <= 1 for a in alerts)
    assert len({a.alert_id for a in alerts}) == len(alerts)
    assert tuple(N.verify(engine.ledger(made)).first())[:2] == (True, len(alerts))
    assert engine.host_false_positives(got["flows"], made).first().flagged == 0
    assert all(1 <= len(a.flow_ids) <= 8 and a.detector and a.model_version for a in alerts)
    assert got["incidents"].count() == len({a.src_ip for a in alerts})
    made.unpersist()
    got["flows"].unpersist()


def test_synthetic_is_repeatable(spark):
    a, b = (synthetic.flows(spark, 500, parts=n).orderBy("seq").collect() for n in (1, 7))
    assert a == b and len({r.label for r in a}) > 4


def test_empty_flows(spark):
    flows = synthetic.flows(spark, 10).limit(0)
    assert W.anchored(flows).count() == 0 and W.realigned(flows).count() == 0


def test_emit_once_stream(spark, tmp_path):
    rows = [("k", "a", "b", float(t), 0.9) for t in (60, 120, 300, 360, 420, 700)]
    schema = "threat_class string, src_ip string, dst_ip string, window_end double, score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.emit_once(live.stream_table(spark, str(tmp_path / "in"), schema))
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start()  # processing-time timers keep other triggers busy
    assert q.awaitTermination(50)
    assert sorted(r.window_end for r in spark.table("once").collect()) == [60.0, 360.0, 700.0]


def test_no_network_clients():
    assert network_imports(Path(tidewater.__file__).parent) == []
