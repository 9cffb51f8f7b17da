"""Row types, classes and the texts that alerts are enriched with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOW = (
    "seq bigint, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, duration double, pkts_out bigint, pkts_in bigint, "
    "bytes_out bigint, bytes_in bigint, syn int, synack int, rst int, fin int, pkt_sizes array<int>, dns_qname string, dns_qtype string, dns_rcode string, "
    "tls_ja4 string, tls_ja3 string, tls_sni string, tls_self_signed boolean, tls_cert_days int, ics_proto string, ics_func int, ics_unit int, "
    "ics_write boolean, ics_illegal boolean, label string"
)

#: Class, severity, technique, technique's name, tactic.
THREATS = (
    ("volumetric_ddos", "high", "T1498", "Network Denial of Service", "Impact"),
    ("c2_beaconing", "high", "T1071", "Application Layer Protocol", "Command & Control"),
    ("dga_resolution", "medium", "T1568.002", "Dynamic Resolution: DGA", "Command & Control"),
    ("dns_tunnelling", "high", "T1071.004", "Application Layer Protocol: DNS", "Command & Control"),
    ("encrypted_malware", "high", "T1573", "Encrypted Channel", "Command & Control"),
    ("recon_scanning", "low", "T1046", "Network Service Discovery", "Discovery"),
    ("data_exfiltration", "critical", "T1041", "Exfiltration Over C2 Channel", "Exfiltration"),
    ("ics_intrusion", "critical", "T0855", "Unauthorized Command Message (ICS)", "Impair Process Control"),
    ("anomalous_traffic", "medium", "—", "Unmapped — zero-day / unknown-behaviour candidate", "Anomaly"),
)
#: Class, detector, version of its method.
DETECTORS = (
    ("volumetric_ddos", "ddos-entropy-cusum", "0.4.0"),
    ("c2_beaconing", "beacon-logreg", "0.5.0"),
    ("dga_resolution", "dga-lexical-logreg", "0.5.0"),
    ("dns_tunnelling", "dns-tunnel-stats", "0.4.0"),
    ("encrypted_malware", "tls-metadata", "0.4.0"),
    ("recon_scanning", "recon-fanout", "0.3.0"),
    ("data_exfiltration", "exfil-logreg", "0.4.0"),
    ("ics_intrusion", "ics-guard", "0.3.0"),
    ("anomalous_traffic", "anomaly-iforest", "0.2.0"),
)

#: What an analyst is told with an alert.
CAVEATS = {
    "one_way_scan": "degraded: one-way capture — scan inferred from fan-out alone; SYN-ACK/response not observable",
    "metadata": "metadata only — no payload was decrypted",
    "client_side": "degraded: server-side handshake not observed (TLS 1.3 or single-direction tap); scored on client-side evidence only",
    "lead": "lead for analyst review — exfiltration has the weakest passive signal",
    "commands": "OT command traffic — header only, no payload or setpoint read",
    "novel": "zero-day candidate — behaviour far from the benign baseline",
}
SEVERITIES = ("low", "medium", "high", "critical")


def threats(spark: SparkSession) -> DataFrame:
    """The dimension of classes: nine rows, broadcast wherever it is joined."""
    by = {k: rest for k, *rest in DETECTORS}
    rows = [(*t, *by[t[0]]) for t in THREATS]
    return spark.createDataFrame(rows, "threat_class string, base_severity string, technique string, technique_name string, tactic string, detector string, model_version string")
