"""From detections to alerts, incidents and the ledger."""

from __future__ import annotations

import hashlib
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import alert_id, flow_id, registrable
from ..schema import SEVERITIES, threats
from .folds import relay, scan

c = F.col


def union(*detections: DataFrame) -> DataFrame:
    """All detectors' rows with ``ord``, the detector's place, so that emission order is explicit."""
    out = None
    for i, d in enumerate(detections):
        d = d.withColumn("ord", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def suppress(detections: DataFrame, hosts: DataFrame) -> DataFrame:
    """Without detections whose source or destination is in ``hosts`` (column ip)."""
    left = detections.join(hosts.select(c("ip").alias("src_ip")), "src_ip", "left_anti")
    return left.join(hosts.select(c("ip").alias("dst_ip")), "dst_ip", "left_anti")


def dedupe(detections: DataFrame, span: float = 300.0) -> DataFrame:
    """The detections emitted: of a class, source and destination none within ``span`` seconds of the last one emitted.

    A key's detections are scanned in order of window, and of ``ord`` inside one; the first of a window counts.
    """

    def step(last: float | None, x: dict) -> tuple[float, tuple]:
        emit = last is None or x["window_end"] - last >= span
        return x["window_end"] if emit else last, (emit,)

    order = ["window_end", *[x for x in ("ord",) if x in detections.columns], "score", "ts_event"]
    order = [x for x in order if x in detections.columns]
    return scan(detections, ["threat_class", "src_ip", "dst_ip"], order, None, step, "_emit boolean", ["window_end"]).where("_emit").drop("_emit")


def calibrated(score: Column, threat: Column, table: dict[str, tuple[list[float], list[float]]]) -> Column:
    """The value of the last edge at or under the score, the first below all edges; the score itself for a class without."""
    out = score
    for name, (edges, values) in table.items():
        if edges:
            under = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= score))
            out = F.when(threat == name, F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.greatest(under, F.lit(1)))).otherwise(out)
    return out


def severity(base: Column, confidence: Column) -> Column:
    return F.when((confidence < 0.6) & base.isin("critical", "high"), "medium").when((confidence > 0.9) & (base == "medium"), "high").otherwise(base)


def alerts(detections: DataFrame, calibration: dict[str, tuple[list[float], list[float]]] | None = None, hosts: DataFrame | None = None, span: float = 300.0) -> DataFrame:
    """Suppress, dedupe, calibrate, grade and enrich."""
    kept = dedupe(suppress(detections, hosts) if hosts is not None else detections, span)
    raw = F.bround(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)), 3)
    kept = kept.withColumn("raw_score", raw).withColumn("confidence", F.bround(calibrated(c("raw_score"), c("threat_class"), calibration or {}), 3))
    met = kept.join(F.broadcast(threats(detections.sparkSession)), "threat_class")  # nine rows
    return met.select(
        alert_id(c("threat_class"), c("src_ip"), c("dst_ip"), c("window_end")).alias("alert_id"), "threat_class", severity(c("base_severity"), c("confidence")).alias("severity"), "confidence", "raw_score", "src_ip", "dst_ip",
        "ts_event", c("window_end").alias("ts_emitted"), F.bround((c("window_end") - c("ts_event")) * 1000, 1).alias("latency_ms"), "observed_flows", "technique", "technique_name", "tactic", "evidence", "detector", "model_version", "reverse_direction_visible", "caveat",
        *[x for x in ("ord",) if x in detections.columns],
    )


def with_flow_ids(alerts_: DataFrame, flows: DataFrame, horizon: float = 3600.0, most: int = 8) -> DataFrame:
    """Alerts with flow_ids: the first ``most`` flows of the alert's window that its detector looked at, for a beacon the last
    ones of its pair in the horizon. An anomaly's are its source's. Flows meet alerts, which are few, by window and end."""
    cols = [x for x in ("src_port", "dst_port", "proto", "syn", "dns_qname", "tls_ja4", "ics_proto") if x in flows.columns]
    has = lambda x: F.coalesce(c(x), F.lit("")) != "" if x in cols else F.lit(False)
    kind, tcp, asked, control = c("threat_class"), c("proto") == "tcp", c("syn") > 0, has("ics_proto")
    seen = flows.select("ts", "seq", "window_end", c("src_ip").alias("_src"), c("dst_ip").alias("_dst"), *cols)
    mine = alerts_.select("alert_id", "threat_class", "src_ip", "dst_ip", "ts_emitted")
    pair = c("_dst") == c("dst_ip")
    looked = (
        F.when(kind == "dga_resolution", has("dns_qname"))
        .when(kind == "dns_tunnelling", has("dns_qname") & (registrable(c("dns_qname")) == c("dst_ip") if "dns_qname" in cols else F.lit(False)))
        .when(kind == "encrypted_malware", has("tls_ja4") & pair)
        .when(kind == "recon_scanning", tcp & asked & ~control)
        .when(kind == "data_exfiltration", tcp & ~control)
        .when(kind == "ics_intrusion", control)
        .otherwise(kind == "anomalous_traffic")
    )
    here = c("window_end") == c("ts_emitted")
    flood = kind == "volumetric_ddos"
    at = c("ts_emitted")
    met = [
        mine.where(~flood & (kind != "c2_beaconing")).join(seen, here & (c("_src") == c("src_ip")) & looked).withColumn("_t", c("ts")),
        mine.where(flood).join(seen, here & pair & (asked | (c("proto") == "udp"))).withColumn("_t", c("ts")),
        mine.where(kind == "c2_beaconing").join(seen, (c("_src") == c("src_ip")) & pair & tcp & asked & ~control & (c("ts") >= at - horizon) & (c("window_end") <= at + 1e-6)).withColumn("_t", -c("ts")),
    ]
    rows = met[0].unionByName(met[1]).unionByName(met[2])
    order = Window.partitionBy("alert_id").orderBy("_t", F.when(c("_t") < 0, -c("seq")).otherwise(c("seq")))
    first = rows.withColumn("_r", F.row_number().over(order)).where(c("_r") <= most)
    ids = first.groupBy("alert_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", flow_id("_src", "_dst").alias("id")))), lambda x: x["id"]).alias("flow_ids"))
    return alerts_.join(ids, "alert_id", "left").withColumn("flow_ids", F.coalesce("flow_ids", F.array().cast("array<string>")))


def rank_of(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), level)


def incidents(alerts_: DataFrame, gap: float = 1800.0) -> DataFrame:
    """The last incident of each source: alerts in emission order, a new incident after ``gap`` seconds of silence."""
    rows = alerts_.select(c("src_ip").alias("entity"), "ts_emitted", "alert_id", c("ts_event").alias("first"), "threat_class", rank_of(c("severity")).alias("rank"), "confidence")

    def step(state: tuple, x: dict) -> tuple[tuple, tuple]:
        part, last = state
        if last is None or x["first"] - last > gap:
            part, last = part + 1, x["first"]
        return (part, max(last, x["first"])), (part,)

    parts = scan(rows, ["entity"], ["ts_emitted", "alert_id"], (0, None), step, "part bigint", ["first"])
    each = parts.groupBy("entity", "part").agg(F.min("first").alias("first_seen"), F.max("first").alias("last_seen"), F.count("*").cast("int").alias("n_alerts"), F.array_sort(F.collect_set("threat_class")).alias("classes"), F.max("rank").cast("int").alias("worst"), F.max("confidence").alias("best"))
    final = each.withColumn("_last", F.max("part").over(Window.partitionBy("entity"))).where(c("part") == c("_last"))
    score = F.least(c("best") + 0.05 * (F.size("classes") - 1), F.lit(1.0))
    return final.select("entity", "first_seen", "last_seen", "n_alerts", "classes", F.size("classes").alias("n_classes"), F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), c("worst")).alias("severity"), F.bround(score, 3).alias("score"))


def ranked(incidents_: DataFrame, classes: int = 1, limit: int | None = None) -> DataFrame:
    """Incidents of over ``classes`` classes, highest score first."""
    out = incidents_.where(c("n_classes") > classes).orderBy(c("score").desc(), c("n_classes").desc(), "entity")
    return out.limit(limit) if limit else out


def evict(incidents_: DataFrame, now: float, ttl: float = 3600.0, cap: int = 20_000) -> DataFrame:
    """Incidents not older than ``ttl``, at most ``cap``, the latest."""
    return incidents_.where(c("last_seen") >= now - ttl).orderBy(c("last_seen").desc(), "entity").limit(cap)


GENESIS = "0" * 64


def chain(records: DataFrame, order: list[str], body: str, after: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """A hash chain over records in order, on from ``after`` (last seq and hash): seq, body, prev_sha256, sha256 of ``prev|seq|body``.

    Each hash needs the one before, so a chain is sequential by definition: parts of the order are sorted and chained one after
    the other, each by a task in memory bounded by a part.
    """

    def fold(state: tuple[int, str], batches: Iterator[pa.RecordBatch]) -> Generator[pa.RecordBatch, None, tuple[int, str]]:
        seq, last = state
        for batch in batches:
            bodies, before, digests, first = batch.column(0).to_pylist(), [], [], seq + 1
            for x in bodies:
                seq += 1
                before.append(last)
                last = hashlib.sha256("|".join([last, str(seq)] + [x] * (x is not None)).encode("utf-8", "surrogatepass")).hexdigest()
                digests.append(last)
            yield pa.RecordBatch.from_arrays([pa.array(range(first, seq + 1), pa.int64()), pa.array(bodies, pa.string()), pa.array(before, pa.string()), pa.array(digests, pa.string())], names=["seq", "body", "prev_sha256", "sha256"])
        return seq, last

    rows = records.select(*order, c(body).alias("_body"))
    return relay(rows, [*order, "_body"], ["_body"], after, fold, "seq long, body string, prev_sha256 string, sha256 string")


def append(path: str, records: DataFrame, order: list[str], body: str) -> tuple[int, str]:
    """Chain ``records`` on to the ledger kept at ``path`` (begun if there is none); the last seq and hash after that.

    One writer at a time, as every record holds the hash of the one before.
    """
    spark = records.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    begun = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    last = tuple(resume(spark.read.parquet(path)).first()) if begun else (0, GENESIS)
    chain(records, order, body, last).write.mode("append").parquet(path)
    return tuple(resume(spark.read.parquet(path)).first())


def verify(ledger: DataFrame) -> DataFrame:
    """One row: ok, n, and the first bad seq. Each record is checked against its neighbour by join, so in parallel."""
    want = F.sha2(F.concat_ws("|", "prev_sha256", c("seq").cast("string"), "body"), 256)
    mine = ledger.select("seq", "prev_sha256", (want != c("sha256")).alias("_bad"))  # bodies stay where they are
    before = ledger.select((c("seq") + 1).alias("seq"), c("sha256").alias("held"))
    met = mine.join(before, "seq", "left")
    bad = c("_bad") | (c("prev_sha256") != F.when(c("seq") == 1, GENESIS).otherwise(F.coalesce("held", F.lit(""))))
    out = met.agg(F.count("*").alias("n"), F.min(F.when(bad, c("seq"))).alias("first_bad"))
    return out.select(c("first_bad").isNull().alias("ok"), "n", "first_bad")


def resume(ledger: DataFrame) -> DataFrame:
    """One row: the last seq and hash."""
    return ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"), F.coalesce(F.max_by("sha256", "seq"), F.lit(GENESIS)).alias("sha256"))
