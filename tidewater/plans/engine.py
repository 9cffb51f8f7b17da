"""The whole engine as one plan: flows to detections, alerts, incidents and the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import anomaly as A
from ..operators import detectors as D
from ..operators import fusion as N
from ..operators import windows as W
from ..schema import FLOW

c = F.col


@dataclass(frozen=True)
class Config:
    """Everything that can be set; the defaults are the product's."""

    width: float = 60.0
    realign: bool = True
    one_way: bool = False
    flood: D.Flood = D.Flood()
    beacon: D.Beacon = D.Beacon()
    dga: D.Dga = D.Dga()
    tunnel: D.Tunnel = D.Tunnel()
    tls: D.Tls = D.Tls()
    recon: D.Recon = D.Recon()
    exfil: D.Exfil = D.Exfil()
    ics: D.Ics = D.Ics()
    anomaly: A.Anomaly = A.Anomaly()
    forest: A.Forest | None = None
    envelope: tuple[list[float], list[float]] | None = None
    calibration: dict = field(default_factory=dict)
    dedupe: float = 300.0


def detect(flows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Detections of all detectors, in their order. ``flows`` should be kept (``persist``) by the caller: nine read them."""
    beacon = D.Beacon(**{**cfg.beacon.__dict__, "width": cfg.width, "idle": 10 if cfg.realign else None})
    found = [D.flood(flows, cfg.flood), D.beacon(flows, beacon), D.dga(flows, cfg.dga), D.tunnel(flows, cfg.tunnel), D.tls(flows, cfg.tls), D.recon(flows, cfg.recon), D.exfil(flows, cfg.exfil), D.ics(flows, cfg.ics)]
    if cfg.forest is not None and cfg.envelope is not None:
        scored = A.scored(flows, cfg.forest, *cfg.envelope, cfg.anomaly)
        found.append(A.anomalies(A.anomaly_hits(scored, cfg.anomaly), cfg.anomaly, cfg.width))
    return N.union(*found)


def complete(flows: DataFrame) -> DataFrame:
    """``flows`` with every column of the flow schema; what a source doesn't have is null, not observed."""
    return flows.withColumns({n: F.lit(None).cast(t) for n, t in (f.split() for f in FLOW.split(", ")) if n not in flows.columns})


def windowed(flows: DataFrame, cfg: Config = Config()) -> DataFrame:
    seen = X.one_way(complete(flows)) if cfg.one_way else complete(flows)
    return W.realigned(seen, cfg.width) if cfg.realign else W.anchored(seen, cfg.width)


class Results(dict):
    """What a run gives by name; alerts get the ids of their flows when they are asked for."""

    def __missing__(self, name: str) -> DataFrame:
        if name != "alerts":
            raise KeyError(name)
        self[name] = N.with_flow_ids(self["raised"], self["flows"], self["horizon"])
        return self[name]


def run(flows: DataFrame, cfg: Config = Config(), suppress: DataFrame | None = None) -> Results:
    """flows (windowed, kept in memory and on disk once read), detections, raised (alerts without flow ids), alerts, incidents; all lazy."""
    kept = windowed(flows, cfg).persist()
    detections = detect(kept, cfg)
    raised = N.alerts(detections, cfg.calibration, suppress, cfg.dedupe)
    return Results(flows=kept, detections=detections, raised=raised, incidents=N.incidents(raised), horizon=cfg.beacon.horizon)


def record(alerts: DataFrame) -> DataFrame:
    """(ts_emitted, alert_id, body): each alert as nested JSON with sorted keys, ready for the ledger."""
    body = F.struct(
        F.struct(c("alert_id").alias("id"), c("severity"), c("threat_class").alias("kind")).alias("event"),
        F.struct(c("dst_ip").alias("destination"), c("src_ip").alias("source")).alias("network"),
        F.struct(F.round("confidence", 3).alias("confidence"), c("latency_ms"), c("observed_flows"), F.round("raw_score", 3).alias("score")).alias("result"),
        F.struct(c("tactic"), c("technique").alias("technique_id"), c("technique_name")).alias("threat"),
    )
    return alerts.select("ts_emitted", "alert_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def ledger(alerts: DataFrame) -> DataFrame:
    return N.chain(record(alerts), ["ts_emitted", "alert_id"], "body")


def alert_view(alerts: DataFrame, limit: int = 400) -> DataFrame:
    """The latest alerts for display, highest confidence first within a time."""
    return alerts.orderBy(c("ts_emitted").desc(), c("confidence").desc(), "alert_id").limit(limit).select("alert_id", "threat_class", "severity", "confidence", "src_ip", "dst_ip", "ts_event", "ts_emitted", "technique", "tactic")


def class_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("threat_class", "severity").agg(F.count("*").alias("n"))


def retention(both: DataFrame, one: DataFrame) -> DataFrame:
    """Which classes stay visible to a one-way tap: (threat_class, both, one_way, kept)."""
    a = both.groupBy("threat_class").agg(F.count("*").alias("both"))
    b = one.groupBy("threat_class").agg(F.count("*").alias("one_way"))
    return a.join(b, "threat_class", "full").na.fill(0).withColumn("kept", (c("both") > 0) & (c("one_way") > 0))


def host_false_positives(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: benign sources, and those of them that any alert names."""
    hosts = flows.groupBy("src_ip").agg(F.max((c("label") != "benign").cast("int")).alias("bad")).where("bad = 0")
    named = alerts.select("src_ip").distinct().withColumn("hit", F.lit(1))
    return hosts.join(named, "src_ip", "left").agg(F.count("*").alias("hosts"), F.coalesce(F.sum("hit"), F.lit(0)).alias("flagged"))
