"""Registered queries over flows, with DuckDB SQL for the same rows.

Windows and gates are scaled to the tables at hand (days, not minutes); the operators' defaults are the product's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import detectors as D
from ..operators import evaluation as E
from ..operators import fusion as N
from ..operators import windows as W
from ..operators.logistic import Logistic
from ..sources import tables as T

c = F.col
DAY = 86_400.0
RECON = D.Recon(min_targets=3, unanswered=0.3, threshold=0.2)
FLOOD = D.Flood(min_flows=12, entropy_floor=3.0, completion_ceiling=0.9, threshold=0.35)
BEACON = D.Beacon(width=10 * DAY, horizon=30 * DAY, min_events=4, threshold=0.05)
DGA = D.Dga(min_queries=8, threshold=0.3)
TUNNEL = D.Tunnel(min_queries=3, long_name=20, many=10, threshold=0.3)
TLS = D.Tls()
EXFIL = D.Exfil(threshold=0.3)
ICS = D.Ics(scan=3, established=1)
CALIBRATION = {"encrypted_malware": ([0.55, 0.65, 0.75], [0.6, 0.7, 0.92]), "ics_intrusion": ([0.56, 0.8], [0.55, 0.95])}
#: A fixed example model over the event flows' columns.
EXAMPLE = Logistic(("bytes_out", "bytes_in", "duration"), (0.8, -0.5, 1.1), -0.2, (9000.0, 50_000.0, 5.0), (5000.0, 30_000.0, 3.0), 0.5)


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def daily(spark: SparkSession, sf_dir: str, days: float = 1.0) -> DataFrame:
    return W.anchored(T.event_flows(spark, sf_dir), days * DAY)


def recon_fanout(s, d):
    return D.recon_fanout(daily(s, d), RECON).select(*r6("window_end", "unanswered", "score", "ts_event"), "src_ip", "targets", "hosts", "ports", "observed_flows", "reverse_visible")


def recon_detections(s, d):
    return D.recon(daily(s, d), RECON).select(*r6("window_end", "score", "ts_event"), "threat_class", "src_ip", "dst_ip", "observed_flows")


def flow_ids(s, d):
    return X.derived(T.event_flows(s, d)).select("seq", "flow_id", "completed", F.round("byte_ratio", 6).alias("byte_ratio"))


def alert_ids(s, d):
    hits = D.recon(daily(s, d), RECON)
    return hits.select("src_ip", "dst_ip", X.alert_id(c("threat_class"), c("src_ip"), c("dst_ip"), c("window_end")).alias("alert_id"))


def oneway_projection(s, d):
    return X.one_way(T.event_flows(s, d)).select("seq", "pkts_out", "pkts_in", "bytes_out", "bytes_in", "synack", "rst", "tls_self_signed", "tls_cert_days", F.size("pkt_sizes").alias("sizes"))


def rfc1918_split(s, d):
    return T.event_flows(s, d).groupBy(X.is_private(c("src_ip")).alias("src_private"), X.is_private(c("dst_ip")).alias("dst_private")).agg(F.count("*").alias("n"))


def sni_allowlist(s, d):
    return T.event_flows(s, d).where("tls_sni IS NOT NULL").groupBy("tls_sni").agg(F.count("*").alias("n")).withColumn("service", X.is_service_name(c("tls_sni")))


def windows_anchored(s, d):
    return daily(s, d).groupBy(F.round("window_end", 6).alias("window_end")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def windows_realigned(s, d):
    return W.realigned(T.event_flows(s, d), 30.0).groupBy(F.round("window_end", 6).alias("window_end")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def src_entropy(s, d):
    return X.entropy_of_counts(daily(s, d), ["window_end"], "src_ip").select(*r6("window_end", "entropy", "normalised"), "n", "distinct")


def _gaps(s, d):
    from pyspark.sql.window import Window

    return T.event_flows(s, d).withColumn("gap", c("ts") - F.lag("ts").over(Window.partitionBy("src_ip").orderBy("ts", "seq"))).where("gap IS NOT NULL")


def interval_stats(s, d):
    rows = _gaps(s, d)
    stats = rows.groupBy("src_ip").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("sd"), F.percentile("gap", 0.5).alias("median"))
    mad = rows.join(stats.select("src_ip", "median"), "src_ip").groupBy("src_ip").agg(F.percentile(F.abs(c("gap") - c("median")), 0.5).alias("mad"))
    cv = X.variation(c("mean"), c("sd"))
    out = stats.join(mad, "src_ip").withColumns({"cv": cv, "regularity": X.regularity(cv), "jitter_band": X.jitter_band(cv)})
    return out.select("src_ip", "n", *[F.round(x, 4).alias(x) for x in ("mean", "sd", "median", "mad", "cv", "regularity", "jitter_band")])


def autocorr(s, d):
    lists = _gaps(s, d).groupBy("src_ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "gap"))), lambda x: x["gap"]).alias("xs"))
    return lists.select("src_ip", F.round(X.autocorrelation_peak(c("xs")), 5).alias("peak"))


def domain_parts(s, d):
    return T.name_flows(s, d).select("seq", "dns_qname", F.size(X.labels(c("dns_qname"))).alias("n_labels"), X.registrable(c("dns_qname")).alias("parent"))


def lexical(s, d):
    return T.name_flows(s, d).select("seq", *[F.round(v, 6).alias(k) for k, v in X.lexical(c("dns_qname")).items()])


def bigram_fit(s, d):
    return X.bigram_table(T.name_flows(s, d)).select("pair", F.round("logp", 6).alias("logp"))


def bigram_ll(s, d):
    flows = T.name_flows(s, d)
    return X.bigram_likelihood(flows, X.bigram_table(flows), "seq").select("seq", F.round("bigram_ll", 6).alias("bigram_ll"))


def shape_features(s, d):
    sizes = T.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("z"))
    return sizes.select("vec_id", *[F.round(v, 6).alias(k) for k, v in X.shape(c("z")).items()])


def anomaly_vector(s, d):
    return T.event_flows(s, d).select("seq", *[F.round(v, 6).alias(f"v{i}") for i, v in enumerate(X.anomaly_vector())])


def nearest_rank_pct(s, d):
    return E.nearest_rank(T.event_flows(s, d), "bytes_out", [0.5, 0.95, 0.99])


def floor_pct_envelope(s, d):
    return E.floor_rank(T.event_flows(s, d), "bytes_out", [0.001, 0.01, 0.99, 0.999])


def ddos_windows(s, d):
    return D.flood_windows(daily(s, d), FLOOD).select(*r6("window_end", "entropy", "completion", "ts_event"), "dst_ip", "n", "sources", "udp", "reflections")


def ddos_ewma_freeze(s, d):
    return D.flood_scores(daily(s, d), FLOOD).select(*r6("window_end", "base", "score"), "dst_ip", "n")


def beacon_pairs(s, d):
    out = D.beacon_pairs(daily(s, d, 10), BEACON)
    return out.select("src_ip", "dst_ip", F.round("window_end", 3).alias("window_end"), c("n_events").cast("bigint").alias("n_events"), c("dst_prevalence").cast("bigint").alias("dst_prevalence"), *[F.round(x, 4).alias(x) for x in ("interval_cv", "mad_ratio", "byte_cv", "regularity", "jitter_band", "dst_external", "score")])


def _names(s, d):
    return W.anchored(T.name_flows(s, d), 1e6)


def dga_hosts(s, d):
    return D.dga_hosts(_names(s, d), DGA).select("src_ip", "dst_ip", "observed_flows", *r6("suspicious", "nx", "mean_score", "score"), F.array_join("examples", ",").alias("examples"))


def tunnel_parents(s, d):
    return D.tunnel_parents(_names(s, d), TUNNEL).select("src_ip", "parent", "observed_flows", "unique_names", "bytes_up", "bytes_down", *r6("long_rate", "type_rate", "unique_rate", "mean_length", "score"))


def tls_pairs(s, d):
    return D.tls_pairs(daily(s, d), TLS).select(*r6("window_end", "out_share", "size_mean", "score"), "src_ip", "dst_ip", "ja4", "ja4_hosts", "dst_hosts", "hosts", "self_signed", "min_days", "no_sni", "cert_seen", "observed_flows")


def _volumes(s, d):
    return W.anchored(T.volume_flows(s, d), 30 * DAY, T.volume_origin(s, d))


def exfil_windows(s, d):
    out = D.exfil_windows(_volumes(s, d), EXFIL)
    return out.select("src_ip", "dst_ip", "bytes_up", "bytes_down", "observed_flows", F.round("window_end", 3).alias("window_end"), "ratio", "base", "dst_concentration", "out_share", *[(F.round(c(x) * 1e5) / 1e5).alias(x) for x in ("deviation", "dst_novelty", "dst_external", "score")])


def ics_writes(s, d):
    out = D.ics_sources(W.anchored(T.control_flows(s, d), 5 * DAY), ICS)
    return out.select(*r6("window_end", "score"), "src_ip", "dst_ip", "observed_flows", F.array_join(c("funcs").cast("array<string>"), ",").alias("funcs"), "controllers", "writes", "unauthorised", "illegal")


def _detections(s, d):
    """What all detectors over tables find: eight of the nine; the ninth learns its forest from the same flows, see ``anomaly_hits``."""
    flows = daily(s, d)
    control = W.anchored(T.control_flows(s, d), 5 * DAY)
    names, volumes = _names(s, d), _volumes(s, d)
    return N.union(D.flood(flows, FLOOD), D.beacon(daily(s, d, 10), BEACON), D.dga(names, DGA), D.tunnel(names, TUNNEL), D.tls(flows, TLS), D.recon(flows, RECON), D.exfil(volumes, EXFIL), D.ics(control, ICS))


def _alerts(s, d):
    return N.alerts(_detections(s, d), CALIBRATION, None, 2 * DAY)


def dedupe(s, d):
    return N.dedupe(_detections(s, d), 2 * DAY).select("threat_class", "src_ip", "dst_ip", F.round("window_end", 3).alias("window_end"), F.round("score", 4).alias("score"))


def suppress(s, d):
    hosts = s.createDataFrame([("10.42.0.2",), ("203.0.113.3",), ("10.60.0.1",)], "ip string")
    return N.suppress(_detections(s, d), hosts).groupBy("threat_class").agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"))


def alerts(s, d):
    return _alerts(s, d).select("threat_class", "src_ip", "dst_ip", "severity", F.round("confidence", 3).alias("confidence"), F.round("raw_score", 3).alias("raw_score"), F.round("ts_emitted", 3).alias("ts_emitted"), "technique", "tactic", "detector", "model_version", "reverse_direction_visible", "caveat")


def alert_flow_ids(s, d):
    """The flows behind each alert of the two detectors over event flows."""
    flows = daily(s, d)
    found = N.alerts(N.union(D.recon(flows, RECON), D.tls(flows, TLS)), CALIBRATION, None, 2 * DAY)
    return N.with_flow_ids(found, flows).select("alert_id", F.array_join("flow_ids", ",").alias("flow_ids"))


def incidents(s, d):
    return N.incidents(_alerts(s, d), 6 * DAY).select("entity", F.round("first_seen", 3).alias("first_seen"), F.round("last_seen", 3).alias("last_seen"), "n_alerts", "n_classes", "severity", "score")


def ranked_incidents(s, d):
    return N.ranked(N.incidents(_alerts(s, d), 6 * DAY), 1, 10).select("entity", "n_classes", "score")


def _ledger(s, d):
    rows = T.event_flows(s, d).select("seq", F.concat_ws("/", "src_ip", "dst_ip", c("bytes_out").cast("string")).alias("body"))
    return N.chain(rows.withColumnRenamed("seq", "at"), ["at"], "body")


def ledger_chain(s, d):
    return _ledger(s, d)


def ledger_verify(s, d):
    ledger = _ledger(s, d)
    edited = ledger.withColumn("body", F.when(c("seq") == 123, "edited").otherwise(c("body")))
    return N.verify(ledger).withColumn("kind", F.lit("whole")).unionAll(N.verify(edited).withColumn("kind", F.lit("edited")))


def lr_score(s, d):
    return T.event_flows(s, d).select("seq", F.round(EXAMPLE.probability(), 6).alias("p"))


def lr_explain(s, d):
    parts = T.event_flows(s, d).select("seq", F.explode(EXAMPLE.explain(top=2)).alias("e"))
    return parts.select("seq", "e.feature", "e.contribution", "e.value")


QUERIES = {f.__name__: f for f in (
    recon_fanout, recon_detections, flow_ids, alert_ids, oneway_projection, rfc1918_split, sni_allowlist, windows_anchored, windows_realigned, src_entropy, interval_stats, autocorr,
    domain_parts, lexical, bigram_fit, bigram_ll, shape_features, anomaly_vector, nearest_rank_pct, floor_pct_envelope, ddos_windows, ddos_ewma_freeze, beacon_pairs, dga_hosts, tunnel_parents,
    tls_pairs, exfil_windows, ics_writes, dedupe, suppress, alerts, alert_flow_ids, incidents, ranked_incidents, ledger_chain, ledger_verify, lr_score, lr_explain,
)}
