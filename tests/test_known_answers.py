"""Answers known beforehand: features, alert fields, attribution."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import features as X
from tidewater.operators import detectors as D
from tidewater.operators import fusion as N
from tidewater.operators.logistic import Logistic
from tidewater.schema import CAVEATS

c = F.col


def value(spark, column, **given):
    names = ", ".join(f"{k} {t}" for k, (t, _) in given.items())
    return spark.createDataFrame([tuple(v for _, v in given.values())], names).select(column.alias("x")).first().x


def test_autocorrelation_of_constant_short_and_alternating_series(spark):
    peak = lambda xs: value(spark, X.autocorrelation_peak(c("xs")), xs=("array<double>", xs))
    assert peak([5.0] * 6) == 1.0 and peak([5.0] * 3) == 0.0
    assert peak([1.0, 9.0] * 6) == pytest.approx(10 / 12)
    assert 0 <= peak([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]) < 0.4


def test_lexical_keeps_case_and_reads_the_first_label(spark):
    of = lambda name: value(spark, F.struct(*[v.alias(k) for k, v in X.lexical(c("n")).items()]), n=("string", name)).asDict()
    got = of("AEIOUx.Example.com")
    assert (got["vowel_ratio"], got["consonant_run"], got["n_labels"], got["length"]) == (0.0, 6.0, 3.0, 6.0)
    got = of("aeiou-7x.example.com")
    assert got["vowel_ratio"] == pytest.approx(5 / 7) and got["digit_ratio"] == pytest.approx(1 / 7) and got["length"] == 8
    assert of("...")["length"] == 0 and of("...")["entropy"] == 0
    assert of("x7kqp2mfvbzq.com")["vowel_ratio"] < of("cloudflare.com")["vowel_ratio"]


def test_bigram_feature_is_over_the_first_label(spark):
    names = spark.createDataFrame([("cdn.example.com",), ("www.example.com",)], "dns_qname string")
    table = X.bigram_table(names)
    logp = {r.pair: r.logp for r in table.collect()}
    flows = spark.createDataFrame([(0, 1.0, "10.0.0.2", "10.0.0.53", "C-dn.example.com", "NOERROR", 60.0)], "seq long, ts double, src_ip string, dst_ip string, dns_qname string, dns_rcode string, window_end double")
    model = Logistic(("bigram_ll",), (1.0,), 0.0, (0.0,), (1.0,), 0.5)
    got = D.name_scores(flows, D.Dga(model=model), table).first().name_score
    want = sum(logp[p] for p in ("^c", "cd", "dn")) / 4 + logp.get("n$", logp["__default__"]) / 4
    assert got == pytest.approx(1 / (1 + math.exp(-want)))


def flow(i, ts, src, dst, **more):
    given = {"src_port": 1000 + i, "dst_port": 443, "proto": "tcp", "syn": 1, "synack": 1, "bytes_out": 100, "bytes_in": 50, "dns_qname": None, "dns_rcode": None, "tls_ja4": None, "tls_sni": None, "ics_proto": None}
    return (i, float(ts), src, dst, *(given | more).values())


FIELDS = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, syn int, synack int, bytes_out long, bytes_in long, dns_qname string, dns_rcode string, tls_ja4 string, tls_sni string, ics_proto string"


def test_alerts_carry_their_flows_detector_and_caveat(spark):
    rows = [flow(i, i, "10.0.0.9", f"10.1.0.{i % 90}", dst_port=i, synack=0, bytes_in=0) for i in range(200)]
    rows += [flow(500 + i, i * 30, "10.0.0.7", "203.0.113.9", bytes_out=500) for i in range(20)]
    flows = spark.createDataFrame(rows, FIELDS).withColumn("window_end", F.lit(600.0))
    found = N.union(D.recon(flows), D.beacon(flows, D.Beacon(width=600.0)))
    got = {a.threat_class: a for a in N.with_flow_ids(N.alerts(found), flows).collect()}
    ids = {r.seq: r.flow_id for r in X.derived(flows).collect()}
    scan, beacon = got["recon_scanning"], got["c2_beaconing"]
    assert scan.flow_ids == [ids[i] for i in range(8)]
    assert beacon.flow_ids == [ids[500 + i] for i in range(12, 20)]
    assert (scan.detector, scan.model_version, scan.reverse_direction_visible, scan.caveat) == ("recon-fanout", "0.3.0", False, CAVEATS["one_way_scan"])
    assert (beacon.detector, beacon.reverse_direction_visible, beacon.caveat) == ("beacon-logreg", True, None)


def test_evidence_says_why_a_model_fired(spark):
    rows = [flow(i, i * 30, "10.0.0.7", "203.0.113.9", bytes_out=500) for i in range(20)]
    rows += [flow(100 + i, i, "10.0.0.8", "10.0.0.53", proto="udp", dns_qname=f"x7kqp2mfv{i}.com", dns_rcode="NXDOMAIN") for i in range(10)]
    flows = spark.createDataFrame(rows, FIELDS).withColumn("window_end", F.lit(600.0))
    model = Logistic(("interval_cv", "n_events"), (-2.0, 1.0), 1.0, (0.5, 10.0), (0.2, 5.0), 0.5)
    said = json.loads(D.beacon(flows, D.Beacon(width=600.0, model=model)).first().evidence)["attribution"]
    assert [(a["feature"], a["contribution"]) for a in said] == [("interval_cv", 5.0), ("n_events", 2.0)]
    names = Logistic(("vowel_ratio", "length"), (-4.0, 0.5), 0.0, (0.3, 8.0), (0.1, 4.0), 0.5)
    said = json.loads(D.dga(flows, D.Dga(model=names)).first().evidence)["attribution"]
    assert said[0]["feature"] == "vowel_ratio" and said[0]["contribution"] == 12.0
