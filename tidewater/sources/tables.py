"""Flows out of the tables at hand: each adapter is one projection, so filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_FLOWS = """
SELECT event_id AS seq, unix_micros(CAST(ts AS TIMESTAMP))/1e6D AS ts,
 concat('10.42.',CAST(user_id div 250 AS STRING),'.',CAST(user_id%250+2 AS STRING)) AS src_ip,
 CASE event_type WHEN 'view' THEN concat('104.18.32.',CAST(k%8 AS STRING)) WHEN 'click' THEN concat('10.42.0.',CAST(k%4+50 AS STRING))
  WHEN 'purchase' THEN concat('203.0.113.',CAST(k%16 AS STRING)) WHEN 'error' THEN concat('10.42.5.',CAST(k%10 AS STRING)) ELSE '10.42.0.53' END AS dst_ip,
 CAST(1024+user_id%60000 AS INT) AS src_port,
 CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 9100 WHEN 'purchase' THEN 443 WHEN 'error' THEN CAST((k*7+user_id)%1024+1 AS INT) ELSE 53 END AS dst_port,
 CASE WHEN event_type='signup' THEN 'udp' ELSE 'tcp' END AS proto, k/10D AS duration, CAST(k+1 AS BIGINT) AS pkts_out, CAST(k%7 AS BIGINT) AS pkts_in,
 CAST(floor(value*100) AS BIGINT) AS bytes_out, CAST(k*1000+60 AS BIGINT) AS bytes_in,
 CASE WHEN event_type='signup' THEN 0 ELSE 1 END AS syn, CASE WHEN event_type IN ('signup','error') THEN 0 ELSE 1 END AS synack,
 CASE WHEN event_type='error' AND k%3=0 THEN 1 ELSE 0 END AS rst, 0 AS fin, array(k+40, -(k*10+1), k%5+1) AS pkt_sizes,
 CASE WHEN event_type IN ('view','purchase') THEN concat('t13d',CAST((user_id*3+k)%37 AS STRING)) END AS tls_ja4,
 CASE WHEN event_type='view' AND k%3>0 THEN concat('site',CAST(k%8 AS STRING),'.example.com') WHEN event_type='purchase' AND k%2=0 THEN 'clients.google.com' END AS tls_sni,
 event_type='purchase' AND k%5=0 AS tls_self_signed, CASE WHEN event_type='purchase' THEN CAST(k%90 AS INT) END AS tls_cert_days, CAST(NULL AS STRING) AS ics_proto,
 CAST(NULL AS STRING) AS dns_rcode
FROM (SELECT *, CAST(get_json_object(props,'$.k') AS INT) AS k FROM {events}) e0
"""

CONTROL_FLOWS = """
SELECT event_id AS seq, unix_micros(CAST(ts AS TIMESTAMP))/1e6D AS ts, concat('10.43.0.',CAST(user_id%40 AS STRING)) AS src_ip, concat('10.60.0.',CAST(k%6 AS STRING)) AS dst_ip,
 'modbus' AS ics_proto, CAST(k%9+1 AS INT) AS ics_func, event_type='error' AS ics_write, k=99 AS ics_illegal
FROM (SELECT *, CAST(get_json_object(props,'$.k') AS INT) AS k FROM {events}) e0 WHERE event_type IN ('click','error','view')
"""

VOLUME_FLOWS = """
SELECT unix_micros(CAST(l_shipdate AS TIMESTAMP))/1e6D AS ts, CAST(l_orderkey*10+l_linenumber AS BIGINT) AS seq,
 concat('10.50.',CAST(l_suppkey div 250 AS STRING),'.',CAST(l_suppkey%250+2 AS STRING)) AS src_ip,
 CASE WHEN o_custkey%3=0 THEN concat('10.60.0.',CAST(o_custkey%200+2 AS STRING)) ELSE concat('198.51.100.',CAST(o_custkey%200+2 AS STRING)) END AS dst_ip,
 'tcp' AS proto, CAST(NULL AS STRING) AS ics_proto, CAST(NULL AS STRING) AS tls_sni,
 CAST(floor(l_extendedprice*CASE WHEN l_returnflag='R' THEN 20 ELSE 1 END) AS BIGINT) AS bytes_out, CAST(floor(l_quantity*1000) AS BIGINT) AS bytes_in
FROM {lineitem} JOIN {orders} ON l_orderkey=o_orderkey
"""

NAME_FLOWS = """
SELECT page_id AS seq, CAST(page_id AS DOUBLE) AS ts, concat('10.42.1.',CAST(page_id%5+2 AS STRING)) AS src_ip, '10.42.0.53' AS dst_ip,
 regexp_extract(url,'^https?://([^/?#]+)',1) AS dns_qname, CASE page_id%7 WHEN 0 THEN 'TXT' WHEN 1 THEN 'CNAME' ELSE 'A' END AS dns_qtype,
 CASE WHEN page_id%4=0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS dns_rcode, CAST(page_id%100 AS BIGINT) AS bytes_out, CAST(page_id%37 AS BIGINT) AS bytes_in
FROM {pages}
"""

LABELLED = """
SELECT d.doc_id AS id, l.quality AS y, l.toxic AS y2, CAST(d.n_chars AS DOUBLE) AS f1, CAST(length(regexp_replace(d.text,'[^0-9]','')) AS DOUBLE) AS f2
FROM {documents} d JOIN {labels} l ON d.doc_id=l.doc_id
"""


def _query(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, EVENT_FLOWS, "events")


def control_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, CONTROL_FLOWS, "events")


def volume_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, VOLUME_FLOWS, "lineitem", "orders")


def volume_origin(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """One row: the first time of ``volume_flows``, without the whole join; None if the earliest lines have no order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    earliest = lines.agg(F.min("l_shipdate").alias("first"))
    early = lines.join(F.broadcast(earliest), F.col("l_shipdate") == F.col("first")).select("l_orderkey")
    if not early.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").take(1):
        return None
    return earliest.select(F.expr("unix_micros(CAST(first AS TIMESTAMP))/1e6D"))


def name_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, NAME_FLOWS, "pages")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, LABELLED, "documents", "labels")
