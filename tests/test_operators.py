from __future__ import annotations

import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import features as X
from tidewater.operators import anomaly as A
from tidewater.operators import detectors as D
from tidewater.operators import fusion as N
from tidewater.operators import logistic as L
from tidewater.operators import windows as W
from tidewater.schema import FLOW
from tidewater.sources import datasets, netflow, packets, wire
from tidewater.sources import tables as T
from tidewater.streaming import live


def flows(spark, rows):
    base = {f.split()[0]: None for f in FLOW.split(", ")} | {"proto": "tcp", "syn": 1, "synack": 1, "src_port": 1, "dst_port": 443, "pkts_out": 1, "bytes_out": 0, "bytes_in": 0}
    return spark.createDataFrame([tuple((base | {"seq": i} | r).values()) for i, r in enumerate(rows)], FLOW)


def at(df, end=60.0):
    return df.withColumn("window_end", F.lit(end))


def test_scan_flood_and_tunnel_fire(spark):
    scan = [{"ts": i * 0.1, "src_ip": "10.0.0.9", "dst_ip": f"10.0.1.{i % 50}", "dst_port": i, "synack": 0, "bytes_in": 0} for i in range(200)]
    scan += [{"ts": 1.0, "src_ip": "10.0.0.9", "dst_ip": "10.0.1.1", "dst_port": 9999, "bytes_in": 5}]
    got = D.recon(at(flows(spark, scan))).collect()
    assert len(got) == 1 and got[0].dst_ip == "50 hosts" and got[0].score > 0.8
    reply = [{"ts": 1.0, "src_ip": f"8.8.{i % 200}.1", "dst_ip": "10.0.0.80", "proto": "udp", "syn": 0, "src_port": 53, "bytes_out": 3000} for i in range(200)]
    got = D.flood(at(flows(spark, reply))).collect()
    assert len(got) == 1 and "udp_reflection_amplification" in got[0].evidence
    names = [{"ts": 1.0, "src_ip": "10.0.0.7", "dst_ip": "10.0.0.53", "proto": "udp", "dns_qname": "a" * 50 + f"{i}.t.example.org", "dns_qtype": "TXT"} for i in range(70)]
    got = D.tunnel(at(flows(spark, names))).collect()
    assert len(got) == 1 and got[0].dst_ip == "example.org" and got[0].score == pytest.approx(1.0)


def test_beacon_regular_fires_and_service_is_quiet(spark):
    rng = random.Random(1)
    beat = [{"ts": 60.0 * i + rng.uniform(-3, 3), "src_ip": "10.0.0.5", "dst_ip": "203.0.113.9", "bytes_out": 500} for i in range(1, 31)]
    noise = [{"ts": rng.uniform(0, 1800), "src_ip": "10.0.0.6", "dst_ip": "104.18.0.1", "bytes_out": rng.randrange(10**6)} for _ in range(30)]
    got = D.beacon(W.anchored(flows(spark, beat + noise), 600.0), D.Beacon(width=600.0)).collect()
    assert {r.dst_ip for r in got} == {"203.0.113.9"}
    quiet = [r | {"tls_sni": "clients.google.com"} for r in beat]
    assert D.beacon(W.anchored(flows(spark, quiet), 600.0), D.Beacon(width=600.0)).count() == 0


def test_beacon_intervals_equal_brute_force(spark):
    rng = random.Random(4)
    cfg = D.Beacon(width=7.0, horizon=40.0, min_events=3)
    rows = [{"ts": round(rng.uniform(0.1234567, 120), 7) if i % 5 else float(i % 60), "src_ip": f"10.0.0.{rng.randrange(3)}", "dst_ip": f"203.0.113.{rng.randrange(2)}", "bytes_out": rng.randrange(900)} for i in range(150)]
    kept = W.anchored(flows(spark, rows), 7.0).persist()
    all_flows = sorted(kept.collect(), key=lambda r: (r.ts, r.seq))
    ended = sorted({round(r.window_end, 6): r.window_end for r in all_flows}.values())
    whole = [ended[0] + 7.0 * i for i in range(round((ended[-1] - ended[0]) / 7.0) + 1)]
    want = {}
    for end in whole:
        pairs = {}
        for r in all_flows:
            if r.window_end < end + 1e-6 and r.ts >= end - 40.0:
                pairs.setdefault((r.src_ip, r.dst_ip), []).append(r)
        for pair, held in pairs.items():
            gaps = np.diff([r.ts for r in held])
            if len(held) >= 3:
                med = float(np.median(gaps))
                want[(*pair, round(end, 4))] = (len(held), float(gaps.mean()), float(np.median(np.abs(gaps - med))) / (med or 1.0), held[-1].ts)
    got = {(r.src_ip, r.dst_ip, round(r.window_end, 4)): (r.n_events, r.m, r.mad_ratio, r.ts_event) for r in D.beacon_pairs(kept, cfg).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    kept.unpersist()


def test_industrial_writer_and_established_poller(spark):
    poll = [{"ts": float(i), "src_ip": "10.0.0.2", "dst_ip": "10.60.0.1", "ics_proto": "modbus", "ics_func": 3, "ics_write": False, "ics_illegal": False} for i in range(6)]
    later = [{"ts": 70.0, "src_ip": "10.0.0.2", "dst_ip": "10.60.0.1", "ics_proto": "modbus", "ics_func": 6, "ics_write": True, "ics_illegal": False}]
    attack = [{"ts": 71.0, "src_ip": "10.0.0.66", "dst_ip": "10.60.0.1", "ics_proto": "modbus", "ics_func": f, "ics_write": f in (5, 6, 16), "ics_illegal": False} for f in (1, 2, 4, 7, 17, 5, 6, 16)]
    got = D.ics(W.anchored(flows(spark, poll + later + attack))).collect()
    assert [r.src_ip for r in got] == ["10.0.0.66"]
    quiet = D.ics(W.anchored(flows(spark, poll + later + attack)), D.Ics(maintenance=((60.0, 80.0),), scan=99))
    assert quiet.count() == 0


def test_exfil_to_new_outside_host(spark):
    rows = [{"ts": w * 60.0 + 1, "src_ip": "10.0.0.8", "dst_ip": "10.60.0.1", "bytes_out": 1000, "bytes_in": 50_000} for w in range(5)]
    rows += [{"ts": 301.0, "src_ip": "10.0.0.8", "dst_ip": "198.51.100.7", "bytes_out": 9_000_000, "bytes_in": 1000}]
    got = D.exfil(W.anchored(flows(spark, rows)), D.Exfil()).collect()
    assert [(r.dst_ip, round(r.score, 2)) for r in got] == [("198.51.100.7", 0.82)]


def test_dedupe_and_ledger(spark):
    d = spark.createDataFrame([("k", "a", "b", float(t), 0.9) for t in (60, 120, 300, 360, 420, 700)], "threat_class string, src_ip string, dst_ip string, window_end double, score double")
    assert sorted(r.window_end for r in N.dedupe(d).collect()) == [60.0, 360.0, 700.0]
    ledger = N.chain(spark.createDataFrame([(i, f"body {i}") for i in range(5)], "at int, body string"), ["at"], "body")
    assert tuple(N.verify(ledger).first()) == (True, 5, None)
    assert N.verify(ledger.withColumn("body", F.when(F.col("seq") == 3, "x").otherwise(F.col("body")))).first().first_bad == 3
    assert tuple(N.verify(ledger.limit(0)).first()) == (True, 0, None)
    assert N.resume(ledger).first().seq == 5


def test_realign_equals_a_plain_clock(spark):
    rng, t, times = random.Random(3), 0.0, []
    for _ in range(400):
        t += rng.choice([0.5, 3, 20, 95, 101, 108, 115, 400])
        times.append(t)
    end, want = None, []
    for x in times:
        if end is None:
            end = x + 10
        elif x - end > 100:
            end = x + 10
        while x >= end:
            end += 10
        want.append(end)
    df = spark.createDataFrame(list(enumerate(times)), "seq int, ts double")
    got = [r.window_end for r in W.realigned(df, 10.0).orderBy("seq").collect()]
    assert got == pytest.approx(want)


def test_logistic_fit_and_attribution(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(a + 0.5 * b + rng.normal() * 0.3 > 0)) for a, b in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    m = L.fit(df, ["a", "b"])
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    mu, sd = x.mean(0), x.std(0, ddof=1)
    z, w, b = (x - mu) / sd, np.zeros(2), 0.0
    cw = np.where(y == 1, min((y == 0).sum() / y.sum(), 25.0), 1.0)
    for _ in range(600):
        e = (1 / (1 + np.exp(-(z @ w + b))) - y) * cw
        b -= 0.5 * e.sum() / cw.sum()
        w = w - 0.5 * (e @ z / cw.sum() + 1e-3 * w)
    assert m.w == pytest.approx(tuple(w), abs=1e-6) and m.b == pytest.approx(b, abs=1e-6)
    r = df.select(m.probability().alias("p"), m.explain(top=2).alias("e")).first()
    assert sum(t.contribution for t in r.e) + m.b == pytest.approx(math.log(r.p / (1 - r.p)), abs=0.01)
    assert L.Logistic.from_json(m.to_json()) == m


def test_forest_and_autoencoder_find_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    forest = A.fit_forest(x, 80, 128)
    assert forest.score(np.full((1, 6), 12.0))[0] > forest.score(x).max()
    assert np.allclose(A.Forest.from_json(forest.to_json()).score(x), forest.score(x), atol=1e-12)
    x = rng.normal(size=(400, 8))
    net = A.Autoencoder(8).fit(x, epochs=30)
    assert net.error(rng.normal(6, 1, (50, 8))).mean() > 2 * net.error(x).mean()


def test_netflow_and_captures(spark, tmp_path):
    rows = [{"src": "10.0.0.1", "dst": "8.8.8.8", "sport": 5, "dport": 443, "proto": 6, "flags": 0x12, "pkts": 3, "bytes": 900, "first": 90_000, "last": 95_000}, {"src": "10.0.0.2", "dst": "8.8.4.4", "sport": 6, "dport": 53, "proto": 17, "flags": 0, "pkts": 1, "bytes": 60, "first": 1000, "last": 1000}]
    raw = wire.netflow_v5(rows)
    df = spark.createDataFrame([(bytearray(x),) for x in (raw, raw[:100], b"", b"\0\5")] + [(None,)], "datagram binary")
    got = netflow.decode(df).orderBy("src_ip").collect()
    assert len(got) == 3 and (got[0].syn, got[0].synack, got[0].duration, got[-1].proto) == (1, 1, 5.0, "udp")
    assert got[0].ts == pytest.approx(1_757_900_000 - 100 + 90)
    sample = [(t, bytes(p)) for t, _, p in wire.sample_packets()]
    for i, blob in enumerate((wire.pcap(sample), wire.pcap(sample, order=">"), wire.pcap(sample, nano=True), wire.pcapng(sample), wire.pcap(sample) + b"\1\2\3")):
        got = list(packets.packets_of(blob))
        assert [p for _, _, p in got] == [p for _, p in sample] and [t for t, _, _ in got] == pytest.approx([t for t, _ in sample], abs=1e-5)
        (tmp_path / f"{i}.pcap").write_bytes(blob)
    frames = packets.read_captures(spark, str(tmp_path / "0.pcap"))
    made = packets.assemble(packets.decode(frames)).orderBy("ts", "dst_port").collect()
    web = [f for f in made if f.dst_port == 443]
    assert [(f.pkts_out, f.pkts_in, f.syn, f.synack, f.tls_sni) for f in web] == [(3, 2, 1, 1, "www.example.com")] * 2
    assert all(re.fullmatch(r"t13d\d{4}h2_[0-9a-f]{12}_[0-9a-f]{12}", f.tls_ja4) for f in web)
    ask = next(f for f in made if f.dst_port == 53)
    assert (ask.dns_qname, ask.dns_rcode) == ("missing.example.org", "NXDOMAIN")
    assert sum(bool(f.ics_write) for f in made if f.dst_port == 502) == 1


def test_parsers_survive_random_bytes():
    rng = random.Random(20)
    parsers = (packets.dns, packets.client_hello, packets.certificate, packets.quic_version, packets.modbus, packets.dnp3, packets.iec104, packets.ip_parts, lambda b: packets.fields(0.0, 1, b), lambda b: list(packets.packets_of(b)))
    heads = (b"", b"\x16\x03\x01\x00\x30\x01", b"\x68\x0e", b"\x05\x64", b"\x45\x00", struct.pack("<I", 0x0A0D0D0A), struct.pack("<I", 0xA1B2C3D4))
    for _ in range(3000):
        blob = rng.choice(heads) + rng.randbytes(rng.randrange(64))
        for parse in parsers:
            parse(blob)
    assert packets.modbus(wire.modbus(6))["ics_write"] and packets.modbus(wire.modbus(99))["ics_illegal"] and not packets.modbus(wire.modbus(3))["ics_write"]
    assert packets.iec104(bytes([0x68, 14, 0, 0, 0, 0, 45]) + bytes(9))["ics_write"]


def test_datasets(spark, tmp_path):
    line = ["0", "tcp", "http", "SF", "99", *["1"] * 36, "neptune", "20"]
    (tmp_path / "kdd.txt").write_text(",".join(line) + "\n" + ",".join(["x", *line[1:-2], "normal", "1"]) + "\n")
    rows = datasets.categories(datasets.read_kdd(spark, str(tmp_path / "kdd.txt"))).select("label", "category", datasets.kdd_vector().alias("v")).collect()
    assert [(r.label, r.category, len(r.v)) for r in rows] == [(1, "dos", 52), (0, "normal", 52)] and rows[0].v[1] == 2.0
    (tmp_path / "unsw.csv").write_text("﻿id," + ",".join(datasets.UNSW) + ",proto,service,state,attack_cat,label\n1," + ",".join(["3"] * 39) + ",tcp,-,FIN, Fuzzers ,1\n")
    r = datasets.read_unsw(spark, str(tmp_path / "unsw.csv")).select("label", "attack_cat", datasets.unsw_vector(("dur",), ("tcp", "udp"), ("FIN", "CON")).alias("v")).first()
    assert (r.label, r.attack_cat, len(r.v), r.v[-4:]) == (1, "Fuzzers", 43, [1.0, 0.0, 1.0, 0.0])


def test_stream_equals_batch(spark, small, tmp_path):
    flows_ = T.event_flows(spark, small).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).drop("pkt_sizes")
    flows_.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    cfg, width = D.Recon(min_targets=2, unanswered=0.0), 7 * 86_400.0
    first = flows_.agg(F.min("ts")).first()[0]
    schema = ", ".join(f"{n} {t}" for n, t in flows_.dtypes)
    stream = live.recon_stream(live.stream_table(spark, str(tmp_path / "in"), schema, 4), cfg, width, first % width, "0 seconds")
    q = stream.writeStream.format("memory").queryName("fanout").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(round(r.window_end, 3), r.src_ip): (r.targets, r.observed_flows, round(r.score, 6)) for r in spark.table("fanout").collect()}
    batch = D.recon_fanout(W.anchored(flows_, width), cfg).collect()
    want = {(round(r.window_end, 3), r.src_ip): (r.targets, r.observed_flows, round(r.score, 6)) for r in batch}
    closed = max(k[0] for k in want)
    assert got == {k: v for k, v in want.items() if k[0] < closed} and len(got) > 5


def test_features(spark):
    ips = ["10.1.1.1", "172.16.0.1", "172.32.0.1", "192.168.3.4", "8.8.8.8", "37 hosts", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "i int, ip string").orderBy("i").select(X.is_private(F.col("ip"))).collect()]
    assert got == [True, True, False, True, False, False, False, False]
    r = spark.createDataFrame([("xKqpmfvbzq.Example.com",)], "q string").select(X.consonant_run(F.col("q")).alias("run"), X.registrable(F.col("q")).alias("p"), X.string_entropy(F.lit("aabb")).alias("h"), X.is_service_name(F.lit("a.GOOGLE.com.")).alias("s")).first()
    assert (r.run, r.p, r.h, r.s) == (10, "Example.com", 1.0, True)


def test_beacon_keeps_its_horizon_over_a_realignment(spark):
    rows = [{"ts": 60.0 * i, "src_ip": "10.0.0.5", "dst_ip": "203.0.113.9", "bytes_out": 500} for i in range(8)]
    rows += [{"ts": 1500.0, "src_ip": "10.0.0.5", "dst_ip": "203.0.113.9", "bytes_out": 500}]
    kept = W.realigned(flows(spark, rows), 60.0)
    got = {r.window_end: r.n_events for r in D.beacon_pairs(kept, D.Beacon(width=60.0, idle=10)).collect()}
    assert got == {360.0: 6, 420.0: 7, 480.0: 8, 1560.0: 9}
    assert {round(e) for e in D.window_ends(kept, 60.0, 10)} == {60, 120, 180, 240, 300, 360, 420, 480, 1560}


def test_hello_that_a_capture_cut_off_gives_what_is_whole():
    from tidewater.sources import packets, wire

    whole = wire.client_hello("www.example.com")
    full = packets.client_hello(whole)
    assert full["tls_sni"] == "www.example.com" and full["tls_ja4"].startswith("t13d0305h2")
    seen = [packets.client_hello(whole[:n]) for n in range(len(whole))]
    named = [i for i, x in enumerate(seen) if x and x["tls_sni"] == "www.example.com"]
    assert len(named) > 30 and all(seen[i] is None or set(seen[i]) == set(full) for i in range(len(whole)))
    assert seen[whole.index(b"www") + 3]["tls_sni"] == "www"
