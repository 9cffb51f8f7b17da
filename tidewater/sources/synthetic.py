"""Synthetic flows at any scale: every column is a hash of the row's number, so partitions need no shared generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def flows(spark: SparkSession, count: int, seed: int = 1337, duration: float = 1800.0, benign: float = 0.85, scale: float = 1.0, jitter: float = 0.2, parts: int | None = None) -> DataFrame:
    """Labelled flows: web, lookups and pollers, and floods, beacons, generated names, tunnels, scans, uploads and control writes.

    ``benign`` is the share of ordinary flows, ``scale`` multiplies their volume, ``jitter`` widens beacon intervals.
    """
    rand = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1_000_000)) / 1e6
    whole = lambda k, n: F.floor(rand(k) * n).cast("int")
    kinds = ("volumetric_ddos", "c2_beaconing", "dga_resolution", "dns_tunnelling", "recon_scanning", "data_exfiltration", "ics_intrusion")
    label = F.when(rand(0) < benign, "benign").otherwise(F.element_at(F.array(*[F.lit(k) for k in kinds]), whole(1, len(kinds)) + 1))
    rows = spark.range(0, count, 1, parts or spark.sparkContext.defaultParallelism).withColumn("label", label)

    def by_label(other: Column, **values: Column) -> Column:
        out = other
        for k, v in values.items():
            out = F.when(c("label") == k, v).otherwise(out)
        return out

    host = F.concat(F.lit("10.42.0."), (whole(2, 60) + 2).cast("string"))
    word = lambda k: F.substring(F.hex(F.xxhash64(F.lit(seed), F.lit(k), "id")), 1, 12)
    beat = F.floor(rand(3) * duration / 60) * 60 + (rand(4) - 0.5) * 60 * jitter
    lookup = c("label").isin("dga_resolution", "dns_tunnelling") | ((c("label") == "benign") & (rand(5) < 0.3))
    return rows.select(
        c("id").alias("seq"), by_label(rand(3) * duration, c2_beaconing=beat).alias("ts"),
        by_label(host, volumetric_ddos=F.concat_ws(".", whole(6, 200) + 1, whole(7, 256), whole(8, 256), whole(9, 254) + 1), c2_beaconing=F.lit("10.42.0.66"), recon_scanning=F.lit("10.42.0.77"), data_exfiltration=F.lit("10.42.0.88"), ics_intrusion=F.lit("10.43.0.99")).alias("src_ip"),
        by_label(F.when(lookup, F.lit("10.42.0.53")).otherwise(F.concat(F.lit("104.18.32."), whole(10, 250).cast("string"))), volumetric_ddos=F.lit("10.42.5.1"), c2_beaconing=F.lit("203.0.113.7"), recon_scanning=F.concat(F.lit("10.42.5."), whole(11, 200).cast("string")), data_exfiltration=F.lit("198.51.100.9"), ics_intrusion=F.concat(F.lit("10.60.0."), whole(12, 6).cast("string"))).alias("dst_ip"),
        (whole(13, 60_000) + 1024).alias("src_port"), by_label(F.when(lookup, F.lit(53)).otherwise(F.lit(443)), recon_scanning=whole(14, 1024) + 1, ics_intrusion=F.lit(502)).alias("dst_port"), F.when(lookup, "udp").otherwise("tcp").alias("proto"), (rand(15) * 10).alias("duration"),
        (whole(16, 20) + 1).cast("bigint").alias("pkts_out"), whole(17, 20).cast("bigint").alias("pkts_in"),
        by_label(F.floor((rand(18) * 2000 + 200) * scale), data_exfiltration=F.floor(rand(18) * 5e6 + 1e6), volumetric_ddos=F.lit(60)).cast("bigint").alias("bytes_out"), by_label(F.floor((rand(19) * 20_000 + 400) * scale), volumetric_ddos=F.lit(0), recon_scanning=F.lit(0)).cast("bigint").alias("bytes_in"),
        F.when(lookup, 0).otherwise(1).alias("syn"), F.when(lookup | c("label").isin("volumetric_ddos", "recon_scanning"), 0).otherwise(1).alias("synack"), F.lit(0).alias("rst"), F.lit(0).alias("fin"),
        F.when(lookup, by_label(F.concat(F.lit("www.site"), whole(20, 40).cast("string"), F.lit(".example.com")), dga_resolution=F.concat(F.lower(word(21)), F.lit(".net")), dns_tunnelling=F.concat(F.lower(F.concat(word(22), word(23), word(24), word(25))), F.lit(".t.example.org")))).alias("dns_qname"),
        F.when(lookup, by_label(F.lit("A"), dns_tunnelling=F.lit("TXT"))).alias("dns_qtype"), F.when(lookup, by_label(F.lit("NOERROR"), dga_resolution=F.lit("NXDOMAIN"))).alias("dns_rcode"),
        F.when(~lookup & (c("label") != "ics_intrusion"), F.concat(F.lit("t13d"), whole(26, 5).cast("string"))).alias("tls_ja4"), F.lit(None).cast("string").alias("tls_sni"), F.lit(False).alias("tls_self_signed"), F.lit(None).cast("int").alias("tls_cert_days"),
        F.when(c("label") == "ics_intrusion", "modbus").alias("ics_proto"), F.when(c("label") == "ics_intrusion", whole(27, 20) + 1).alias("ics_func"), F.array(whole(28, 1400) + 60, -(whole(29, 1400) + 60), whole(30, 400) + 60).alias("pkt_sizes"), (c("label") == "ics_intrusion").alias("ics_write"), F.lit(False).alias("ics_illegal"), "label",
    )
