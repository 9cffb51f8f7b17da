"""Two public intrusion datasets as DataFrames: their schemas, numeric vectors and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

#: The 41 columns of the first dataset, in order; those scaled by a logarithm; families of attacks.
KDD = (
    "duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in num_compromised root_shell su_attempted num_root num_file_creations num_shells num_access_files num_outbound_cmds "
    "is_host_login is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count dst_host_same_srv_rate dst_host_diff_srv_rate "
    "dst_host_same_src_port_rate dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate"
).split()
KDD_TEXT = ("protocol_type", "service", "flag")
KDD_LOG = ("duration", "src_bytes", "dst_bytes", "count", "srv_count", "dst_host_count", "dst_host_srv_count", "num_root", "num_compromised")
KDD_PROTOCOLS = ("tcp", "udp", "icmp")
KDD_FLAGS = ("SF", "S0", "REJ", "RSTR", "RSTO", "SH", "S1", "S2", "S3", "OTH", "RSTOS0")
FAMILIES = {
    "normal": ("normal",),
    "dos": ("neptune", "smurf", "back", "teardrop", "pod", "land", "apache2", "processtable", "mailbomb", "udpstorm", "worm"),
    "probe": ("satan", "ipsweep", "portsweep", "nmap", "mscan", "saint"),
    "r2l": ("warezclient", "guess_passwd", "warezmaster", "imap", "ftp_write", "multihop", "phf", "spy", "sendmail", "named", "snmpgetattack", "snmpguess", "xlock", "xsnoop", "httptunnel"),
    "u2r": ("buffer_overflow", "rootkit", "loadmodule", "perl", "sqlattack", "xterm", "ps"),
}
#: The numeric columns of the second dataset, in the vector's order.
UNSW = (
    "dur spkts dpkts sbytes dbytes rate sttl dttl sload dload sloss dloss sinpkt dinpkt sjit djit swin stcpb dtcpb dwin tcprtt synack ackdat smean dmean trans_depth response_body_len ct_srv_src ct_state_ttl ct_dst_ltm "
    "ct_src_dport_ltm ct_dst_sport_ltm ct_dst_src_ltm is_ftp_login ct_ftp_cmd ct_flw_http_mthd ct_src_ltm ct_srv_dst is_sm_ips_ports"
).split()


def read_kdd(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated, no header: 41 features, attack, level. A number that doesn't parse is 0; short lines are dropped."""
    raw = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in [*KDD, "attack", "level"])).where(c("attack").isNotNull())
    numbers = {n: F.coalesce(c(n).try_cast("double"), F.lit(0.0)) for n in KDD if n not in KDD_TEXT}
    return raw.withColumns(numbers | {"attack": F.lower(F.trim("attack"))}).withColumn("label", (c("attack") != "normal").cast("int"))


def read_unsw(spark: SparkSession, path: str) -> DataFrame:
    """With a header; rows without either target are dropped; missing numbers are 0."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[n.lstrip("﻿") for n in raw.columns]).where(c("label").isNotNull() | c("attack_cat").isNotNull())
    family = F.coalesce(F.nullif(F.trim("attack_cat"), F.lit("")), F.lit("Normal"))
    label = F.coalesce(c("label").try_cast("double").cast("int"), (F.lower(family) != "normal").cast("int"))
    return raw.withColumns({n: F.coalesce(c(n).try_cast("double"), F.lit(0.0)) for n in UNSW if n in raw.columns} | {"attack_cat": family, "label": label})


def kdd_vector() -> Column:
    """38 numbers, then one-hot protocol and flag."""
    number = lambda n: F.log10(c(n) + 1) if n in KDD_LOG else c(n)
    return F.array(*[number(n) for n in KDD if n not in KDD_TEXT], *[(c("protocol_type") == p).cast("double") for p in KDD_PROTOCOLS], *[(c("flag") == f).cast("double") for f in KDD_FLAGS])


def unsw_vector(logs: tuple[str, ...], protocols: tuple[str, ...], states: tuple[str, ...]) -> Column:
    """39 numbers (``logs`` scaled where not negative), then one-hot protocol and state."""
    number = lambda n: F.when(c(n) >= 0, F.log10(F.greatest(c(n), F.lit(0.0)) + 1)).otherwise(c(n)) if n in logs else c(n)
    return F.array(*[number(n) for n in UNSW], *[(F.lower("proto") == p).cast("double") for p in protocols], *[(c("state") == s).cast("double") for s in states])


def categories(attacks: DataFrame, column: str = "attack") -> DataFrame:
    """Add the family of an attack; other for a name unheard of."""
    name, family = F.lower(F.trim(column)), F.lit("other")
    for k, names in FAMILIES.items():
        family = F.when(name.isin(*names), k).otherwise(family)
    return attacks.withColumn("category", family)
