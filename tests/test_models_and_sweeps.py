"""Training, sweeps, ledger appends and small operators over flows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.operators import detectors as D
from tidewater.operators import evaluation as E
from tidewater.operators import fusion as N
from tidewater.operators import logistic as L
from tidewater.operators import training
from tidewater.operators import windows as W
from tidewater.plans import sweeps
from tidewater.sources import packets, synthetic, wire
from tidewater.streaming import live


def test_models_learn_their_class_and_serve_the_detectors(spark):
    flows = W.anchored(synthetic.flows(spark, 20_000, benign=0.8)).persist()
    models, bigrams, report = training.trained(flows, epochs=200)
    assert report["dga"]["f1"] > 0.9 and report["dga"]["tp"] > 50
    assert [m.features for m in models.values()] == [tuple(x) for x in (training.BEACON, training.DGA, training.EXFIL)]
    row = training.beacon_set(flows).where("y = 1").first()
    assert row is None or (row.src_ip, row.dst_ip) == ("10.42.0.66", "203.0.113.7")
    named = {r.src_ip for r in D.dga(flows, D.Dga(model=models["dga"]), bigrams).collect()}
    truth = {r.src_ip for r in flows.where("label = 'dga_resolution'").select("src_ip").distinct().collect()}
    assert named <= truth and L.Logistic.from_json(models["exfil"].to_json()) == models["exfil"]
    flows.unpersist()


def test_fit_is_of_a_bounded_sample(spark):
    rows = spark.range(2000).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id >= 1000 AS INT) AS y")
    whole, part = L.fit(rows, ["a"], epochs=300), L.fit(rows, ["a"], epochs=300, sample=400)
    assert whole.mu == part.mu and whole.sigma == part.sigma
    assert part.w[0] == pytest.approx(whole.w[0], rel=0.15)


def test_sweeps(spark):
    got = {r.jitter: r for r in sweeps.jitter_sweep(spark, (0.0, 1.0), (1,), 4000).collect()}
    assert set(got) == {0.0, 1.0} and all(r.beacons == 1 and r.recall in (0.0, 1.0) for r in got.values())
    kept = {r.threat_class: r.kept for r in sweeps.degraded(spark, (1,), 6000).collect()}
    assert kept.get("ics_intrusion") is True
    row = sweeps.host_scores(spark, (1,), 6000).first()
    assert row.tp > 0 and 0 < row.f1 <= 1


def test_host_detection_and_class_rates(spark):
    truth = spark.createDataFrame([("a",), ("b",), ("c",)], "host string")
    named = spark.createDataFrame([("a",), ("b",), ("z",), ("y",)], "host string")
    assert tuple(E.host_detection(truth, named).first())[:3] == (2, 2, 1)
    assert tuple(E.host_detection(truth.limit(0), named.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    rows = spark.createDataFrame([(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)], "y int, said int")
    got = {r.cls: r.fpr for r in E.per_class(rows, "y", "said").collect()}
    assert got == {0: 0.25, 1: 0.25}


def test_truth_prediction_and_eviction(spark):
    alerts = spark.createDataFrame([("c2_beaconing", "a", "x", 0.9), ("recon_scanning", "a", "y", 0.7), ("volumetric_ddos", "3 sources", "v", 0.8)], "threat_class string, src_ip string, dst_ip string, confidence double")
    said = {r.host: (r.classes, r.primary) for r in E.host_prediction(alerts).collect()}
    assert said == {"a": (["c2_beaconing", "recon_scanning"], "c2_beaconing"), "v": (["volumetric_ddos"], "volumetric_ddos")}
    truth = spark.createDataFrame([("a", ["c2_beaconing"]), ("v", ["volumetric_ddos"])], "host string, classes array<string>")
    assert {(r.threat_class, r.correct) for r in E.alert_correct(alerts, truth).collect()} == {("c2_beaconing", True), ("recon_scanning", False), ("volumetric_ddos", True)}
    seen = spark.createDataFrame([("a", 0.0), ("b", 3000.0), ("c", 5000.0)], "entity string, last_seen double")
    assert [r.entity for r in N.evict(seen, 5000.0, 3600.0, 1).collect()] == ["c"] and N.evict(seen, 5000.0).count() == 2


def test_ledger_grows_and_verifies(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"body {i}") for i in range(7)], "at int, body string")
    path = str(tmp_path / "ledger")
    assert N.append(path, rows.where("at < 4"), ["at"], "body")[0] == 4
    seq, last = N.append(path, rows.where("at >= 4"), ["at"], "body")
    whole = {r.seq: r.sha256 for r in N.chain(rows, ["at"], "body").collect()}
    assert (seq, last) == (7, whole[7])
    ledger = spark.read.parquet(path)
    assert tuple(N.verify(ledger).first()) == (True, 7, None)
    assert N.verify(ledger.withColumn("body", F.when(F.col("seq") == 5, "x").otherwise(F.col("body")))).first().first_bad == 5


def test_stream_of_alerts_into_the_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), f"a{i}") for i in range(6)], "ts_emitted double, alert_id string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    told = []
    stream = live.stream_table(spark, str(tmp_path / "in"), "ts_emitted double, alert_id string")
    q = live.to_ledger(stream, str(tmp_path / "ledger"), ["ts_emitted"], "alert_id", told.append).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) is not False
    assert tuple(N.verify(spark.read.parquet(str(tmp_path / "ledger"))).first())[:2] == (True, 6)
    assert sorted(t["alert_id"] for t in told) == [f"a{i}" for i in range(6)]


def test_clock_without_flows():
    assert W.closed_by(100.0, 99.0, 10.0) == ([], 100.0)
    assert W.closed_by(100.0, 125.0, 10.0) == ([100.0, 110.0, 120.0], 130.0)
    assert W.closed_by(100.0, 200.0, 10.0) == ([100.0 + 10 * i for i in range(11)], 210.0)
    assert W.closed_by(100.0, 201.0, 10.0) == ([100.0], 211.0)


def test_ip_versions_are_counted(spark):
    four, six = wire.ipv4("10.0.0.1", "10.0.0.2", 17, b"x"), bytes([0x60]) + bytes(39)
    frames = [(1, wire.ethernet(four)), (1, wire.ethernet(six, 0x86DD)), (1, bytes(12) + b"\x81\x00\x00\x05\x86\xdd" + six), (1, wire.ethernet(b"arp", 0x0806)), (101, four), (101, six), (113, bytes(14) + b"\x86\xdd" + six), (0, b"\x1e\0\0\0" + six), (1, b""), (1, None)]
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in frames], "linktype int, data binary")
    assert {r.version: r.n for r in packets.versions(rows).collect()} == {"ipv4": 2, "ipv6": 5, "other": 3}


def test_engine_stats_have_rates(spark):
    flows = spark.createDataFrame([(float(i), 60.0) for i in range(11)], "ts double, window_end double")
    alerts = spark.createDataFrame([(5.0,), (9.0,)], "latency_ms double")
    row = E.engine_stats(flows, alerts).first()
    assert (row.flows, row.alerts, row.flows_per_second) == (11, 2, 1.1) and row.alerts_per_million == pytest.approx(2e6 / 11)


def test_selftest_and_empty_pool(spark):
    from tidewater.__main__ import selftest
    from tidewater.operators import anomaly as A

    assert all(selftest(spark).values())
    none = spark.createDataFrame([], "id long, v array<double>")
    assert A.autoencoder_score(none, A.autoencoder_of(none, "v", "id"), "v").count() == 0
