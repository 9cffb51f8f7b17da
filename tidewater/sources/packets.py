"""Captures to packets, packets to fields, fields to flows. Malformed bytes give nulls, never errors."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

# -- captures ---------------------------------------------------------------------------------------------------------

#: Magic numbers of classic captures, as read little-endian, to byte order and ticks a second.
MAGIC = {0xA1B2C3D4: ("<", 1e6), 0xD4C3B2A1: (">", 1e6), 0xA1B23C4D: ("<", 1e9), 0x4D3CB2A1: (">", 1e9)}


def packets_of(raw: bytes) -> Iterator[tuple[float, int, bytes]]:
    """(ts, linktype, frame) of a classic or next-generation capture, up to the first record that is cut off."""
    if len(raw) < 12:
        return
    magic = struct.unpack_from("<I", raw)[0]
    if magic in MAGIC:
        order, ticks = MAGIC[magic]
        link, at = struct.unpack_from(order + "I", raw, 20)[0] if len(raw) >= 24 else 0, 24
        while at + 16 <= len(raw):
            sec, part, held, _ = struct.unpack_from(order + "IIII", raw, at)
            if at + 16 + held > len(raw):
                return
            yield sec + part / ticks, link, raw[at + 16 : at + 16 + held]
            at += 16 + held
    elif magic == 0x0A0D0D0A:
        yield from _blocks(raw)


def _blocks(raw: bytes) -> Iterator[tuple[float, int, bytes]]:
    order, faces, at = "<", [], 0
    while at + 12 <= len(raw):
        if raw[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order, faces = ("<" if raw[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", raw, at)
        if size < 12 or at + size > len(raw):
            return
        body = raw[at + 8 : at + size - 4]
        if kind == 1 and len(body) >= 8:
            faces.append((struct.unpack_from(order + "H", body)[0], _ticks(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            face, high, low, held, _ = struct.unpack_from(order + "IIIII", body)
            if face < len(faces) and 20 + held <= len(body):
                yield ((high << 32) | low) / faces[face][1], faces[face][0], body[20 : 20 + held]
        at += size


def _ticks(options: bytes, order: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size >= 1 and at + 4 < len(options):
            value = options[at + 4]
            return float(2 ** (value & 127)) if value & 128 else float(10**value)
        if code == 0:
            break
        at += 4 + size + -size % 4
    return 1e6


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(ts, linktype, data) of every capture under ``path``; a file is a task, as records can't be found from its middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held: list[tuple[float, int, bytes]] = []
                for packet in packets_of(raw):
                    held.append(packet)
                    if len(held) == 4096:
                        yield _packed(held)
                        held = []
                yield _packed(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "ts double, linktype int, data binary")


def _packed(rows: list[tuple[float, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["ts", "linktype", "data"])


# -- fields -----------------------------------------------------------------------------------------------------------

#: Names of record types, answer codes and versions; grease; function codes of industrial protocols.
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
DNS_CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 5: "REFUSED"}
TLS_VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}
GREASE = frozenset(0x0A0A + 0x1010 * i for i in range(16))
MODBUS_WRITES = frozenset((5, 6, 15, 16, 22, 23))
MODBUS_READS = frozenset((1, 2, 3, 4, 7, 11, 12, 17, 20, 21, 24, 43))
IEC104_CONTROL = frozenset((*range(45, 52), *range(58, 65), 100, 101, 102, 103, 105, 106, 107))


class Reader:
    """Big-endian fields off a byte string; a read past its end raises IndexError, which callers turn into null."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise IndexError
        self.at += n
        return self.raw[self.at - n : self.at]

    def num(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def part(self, n: int) -> Reader:
        return Reader(self.take(self.num(n)))

    def more(self, n: int = 1) -> bool:
        return self.at + n <= len(self.raw)

    def some(self, n: int) -> Reader:
        """The next n bytes, or as many as there are."""
        begin, self.at = self.at, min(self.at + n, len(self.raw))
        return Reader(self.raw[begin : self.at])


def safe(parse):
    def run(*args):
        try:
            return parse(*args)
        except (IndexError, UnicodeDecodeError, ValueError, struct.error):
            return None

    run.__name__ = parse.__name__
    return run


@safe
def network_layer(link: int, frame: bytes) -> bytes | None:
    """The IPv4 packet in a frame: Ethernet with any tags, cooked (two versions), raw, or loopback."""
    r = Reader(frame)
    if link == 1:
        r.take(12)
        kind = r.num(2)
        while kind in (0x8100, 0x88A8, 0x9100):
            r.take(2)
            kind = r.num(2)
    elif link == 113:
        r.take(14)
        kind = r.num(2)
    elif link == 276:
        kind = r.num(2)
        r.take(18)
    elif link in (101, 228, 12):
        kind = 0x0800
    elif link == 0:
        kind = 0x0800 if 2 in (int.from_bytes(frame[:4], "little"), r.num(4)) else 0
        r.at = 4
    else:
        return None
    packet = r.raw[r.at :]
    return packet if kind == 0x0800 and packet and packet[0] >> 4 == 4 else None


def versions(frames: DataFrame) -> DataFrame:
    """(version, n): frames (linktype, data) that carry IPv4, IPv6 (known, but not decoded further) or anything else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for link, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.append("ipv4" if network_layer(link, frame or b"") else "ipv6" if _is_ipv6(link, frame or b"") else "other")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["version"])

    return frames.select("linktype", "data").mapInArrow(run, "version string").groupBy("version").agg(F.count("*").alias("n"))


@safe
def _is_ipv6(link: int, frame: bytes) -> bool | None:
    """Whether a frame of any of the known link layers says that it carries IPv6, and its first bits agree."""
    r, at = Reader(frame), {113: 14, 276: 0, 1: 12}
    if link in at:
        r.take(at[link])
        kind = r.num(2)
        while link == 1 and kind in (0x8100, 0x88A8, 0x9100):
            r.take(2)
            kind = r.num(2)
        if link == 276:
            r.take(18)
        return kind == 0x86DD and frame[r.at] >> 4 == 6
    if link == 0:  # loopback: the family's number differs by system
        family = r.num(4)
        return {family, int.from_bytes(frame[:4], "little")} & {10, 23, 24, 28, 30} != set() and frame[4] >> 4 == 6
    return link in (101, 12, 229) and frame[0] >> 4 == 6


@safe
def ip_parts(packet: bytes) -> tuple[str, str, int, bytes, int]:
    """(source, destination, protocol, payload, declared length)."""
    head, total = (packet[0] & 15) * 4, int.from_bytes(packet[2:4], "big")
    if head < 20 or len(packet) < head or total < head:
        raise ValueError
    return ".".join(map(str, packet[12:16])), ".".join(map(str, packet[16:20])), packet[9], packet[head:total], total


@safe
def dns(payload: bytes) -> tuple[str, str, str | None]:
    """(name, type, code) of the first question; no code in a query."""
    r = Reader(payload)
    r.take(2)
    flags, questions = r.num(2), r.num(2)
    r.take(6)
    if not questions:
        raise ValueError
    parts: list[str] = []
    while len(parts) <= 40 and (n := r.num(1)):
        if n & 0xC0:
            r.take(1)
            break
        parts.append(r.take(n).decode("latin-1"))
    kind = r.num(2)
    return ".".join(parts), DNS_TYPES.get(kind, str(kind)), (DNS_CODES.get(flags & 15, str(flags & 15)) if flags & 0x8000 else None)


@safe
def client_hello(payload: bytes) -> dict:
    """Name, JA3 and JA4 of a TLS hello."""
    r = Reader(payload)
    if r.num(1) != 22:
        raise ValueError
    r.take(2)
    r = Reader(r.raw[5 : 5 + r.num(2)])
    if r.num(1) != 1:
        raise ValueError
    r.take(3)
    return hello_fields(r, "t")


def hello_fields(r: Reader, transport: str) -> dict:
    words = lambda p: [p.num(2) for _ in range(len(p.raw) // 2)]
    version = r.num(2)
    r.take(32)
    r.part(1)
    ciphers = words(r.part(2))
    r.part(1)
    kinds, name, curves, points, signatures, alpn, offered = [], None, [], [], [], [], []
    rest = r.some(r.num(2)) if r.more(2) else Reader(b"")
    while rest.more(4):  # what a short capture cut off is missing; what is whole counts
        kind = rest.num(2)
        body = rest.some(rest.num(2))
        if kind in GREASE:
            continue
        kinds.append(kind)
        if kind == 0 and body.more(5):
            body.take(3)
            name = body.some(body.num(2)).raw.decode("ascii", "replace")
        elif kind == 10 and body.more(2):
            curves = words(body.part(2))
        elif kind == 11 and body.more():
            points = list(body.some(body.num(1)).raw)
        elif kind == 13 and body.more(2):
            signatures = words(body.some(body.num(2)))
        elif kind == 16 and body.more(3):
            body.take(2)
            while body.more():
                alpn.append(body.some(body.num(1)).raw.decode("ascii", "replace"))
        elif kind == 43 and body.more():
            body.take(1)
            while body.more(2):
                offered.append(body.num(2))
    plain = lambda xs: [x for x in xs if x not in GREASE]
    dashed = ["-".join(map(str, xs)) for xs in (plain(ciphers), plain(kinds), plain(curves), points)]
    ja3 = hashlib.md5(",".join([str(version), *dashed]).encode(), usedforsecurity=False).hexdigest()
    return {"tls_sni": name, "tls_ja3": ja3, "tls_ja4": ja4(transport, plain(offered) or [version], plain(ciphers), plain(kinds), signatures, name, alpn)}


def ja4(transport: str, versions: list[int], ciphers: list[int], kinds: list[int], signatures: list[int], name: str | None, alpn: list[str]) -> str:
    """The public fingerprint of three parts: counts, sorted ciphers, sorted extensions with signature algorithms."""
    listed = lambda xs: ",".join(f"{x:04x}" for x in xs)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12]
    protocol = alpn[0][0] + alpn[0][-1] if alpn and alpn[0] else "00"
    first = f"{transport}{TLS_VERSIONS.get(max(versions), '00')}{'d' if name else 'i'}{min(len(ciphers), 99):02d}{min(len(kinds), 99):02d}{protocol}"
    return "_".join((first, digest(listed(sorted(ciphers))) if ciphers else "0" * 12, digest(f"{listed(sorted(k for k in kinds if k not in (0, 16)))}_{listed(signatures)}")))


@safe
def certificate(payload: bytes) -> dict:
    """Of the first certificate in a TLS record: whether issuer equals subject, and days of validity."""
    import datetime

    def item(r: Reader) -> tuple[int, bytes]:
        tag, size = r.num(1), r.num(1)
        return tag, r.take(r.num(size & 127) if size & 128 else size)

    r = Reader(payload)
    if r.num(1) != 22:
        raise ValueError
    r.take(4)
    if r.num(1) != 11:
        raise ValueError
    r.take(6)
    _, outer = item(r.part(3))
    body = Reader(item(Reader(outer))[1])
    fields = []
    while body.more() and len(fields) < 6:
        tag, value = item(body)
        if tag != 0xA0:
            fields.append((tag, value))
    issuer, subject, span = fields[2][1], fields[4][1], Reader(fields[3][1])

    def day() -> datetime.date:
        tag, value = item(span)
        text = value.decode("ascii")
        year = int(text[:4]) if tag == 0x18 else 2000 + int(text[:2]) if int(text[:2]) < 50 else 1900 + int(text[:2])
        text = text[4:] if tag == 0x18 else text[2:]
        return datetime.date(year, int(text[:2]), int(text[2:4]))

    start, end = day(), day()
    return {"tls_self_signed": issuer == subject, "tls_cert_days": (end - start).days}


@safe
def quic_version(payload: bytes) -> str:
    """The version mark of a QUIC long header."""
    if payload[0] & 0xC0 != 0xC0:
        raise ValueError
    version = int.from_bytes(payload[1:5], "big")
    if not (version == 1 or version >> 24 == 0xFF or version & 0x0F0F0F0F == 0x0A0A0A0A) or len(payload) < 7:
        raise ValueError
    return f"quic-v{version:x}"


@safe
def modbus(payload: bytes) -> dict:
    r = Reader(payload)
    r.take(2)
    protocol, size, unit, function = r.num(2), r.num(2), r.num(1), r.num(1) & 0x7F
    if protocol or not 2 <= size <= 260:
        raise ValueError
    return {"ics_proto": "modbus", "ics_func": function, "ics_unit": unit, "ics_write": function in MODBUS_WRITES, "ics_illegal": function not in MODBUS_WRITES | MODBUS_READS}


@safe
def dnp3(payload: bytes) -> dict:
    r = Reader(payload)
    if r.num(2) != 0x0564:
        raise ValueError
    r.take(1)
    function, unit = r.num(1) & 15, int.from_bytes(r.take(2), "little")
    return {"ics_proto": "dnp3", "ics_func": function, "ics_unit": unit, "ics_write": function in (3, 4), "ics_illegal": False}


@safe
def iec104(payload: bytes) -> dict:
    if payload[0] != 0x68 or not 4 <= payload[1] <= 253 or len(payload) < 6:
        raise ValueError
    numbered = payload[2] & 1 == 0
    kind = payload[6] if numbered and len(payload) > 6 else None
    return {"ics_proto": "iec104", "ics_func": payload[2] if kind is None else kind, "ics_unit": 0, "ics_write": kind in IEC104_CONTROL, "ics_illegal": False}


INDUSTRIAL = {502: modbus, 20_000: dnp3, 2404: iec104}
FIELDS = (
    "ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, size bigint, flags int, dns_qname string, dns_qtype string, dns_rcode string, "
    "tls_sni string, tls_ja3 string, tls_ja4 string, tls_self_signed boolean, tls_cert_days int, ics_proto string, ics_func int, ics_unit int, ics_write boolean, ics_illegal boolean"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_KINDS = {"double": pa.float64(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def fields(ts: float, link: int, frame: bytes, open_quic: bool = False) -> dict | None:
    """All that is known of one TCP or UDP packet; None for any other. ``open_quic`` reads the hello of QUIC's Initial packets."""
    packet = network_layer(link, frame)
    parts = ip_parts(packet) if packet else None
    if not parts or parts[2] not in (6, 17) or len(parts[3]) < (20 if parts[2] == 6 else 8):
        return None
    src, dst, proto, body, size = parts
    sport, dport = struct.unpack_from("!HH", body)
    out = {"ts": ts, "src_ip": src, "dst_ip": dst, "src_port": sport, "dst_port": dport, "proto": "tcp" if proto == 6 else "udp", "size": size, "flags": 0}
    if proto == 6:
        out["flags"], payload = body[13], body[(body[12] >> 4) * 4 :]
        if payload[:1] == b"\x16":
            out |= client_hello(payload) or certificate(payload) or {}
        for port in (dport, sport):
            if port in INDUSTRIAL and payload and "ics_proto" not in out:
                out |= INDUSTRIAL[port](payload) or {}
    else:
        payload = body[8:]
        if 53 in (sport, dport) and (q := dns(payload)):
            out |= dict(zip(("dns_qname", "dns_qtype", "dns_rcode"), q, strict=True))
        elif 443 in (sport, dport) and (mark := quic_version(payload)):
            out["tls_ja4"] = mark
            if open_quic:
                from .quic import client_hello as quic_hello

                out |= quic_hello(payload) or {}
    return out


def decode(packets: DataFrame, open_quic: bool = False) -> DataFrame:
    """Fields of each TCP or UDP packet over IPv4 of (ts, linktype, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for t, link, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if data and (x := fields(t, link, data, open_quic))]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _KINDS[f.split()[1]]) for n, f in zip(_NAMES, FIELDS.split(", "), strict=True)], names=_NAMES)

    return packets.select("ts", "linktype", "data").mapInArrow(run, FIELDS)


# -- flows ------------------------------------------------------------------------------------------------------------


def assemble(packets: DataFrame, idle: float = 60.0, active: float = 180.0) -> DataFrame:
    """Flows out of packets of both directions: a new one after ``idle`` seconds without a packet or ``active`` since its first.

    The outward direction is that of a flow's first packet (also after a timeout). The two timeouts need one ordered pass
    over a connection's packets, which keeps two numbers; everything else is aggregation.
    """
    mine = F.concat_ws(":", "src_ip", "src_port")
    other = F.concat_ws(":", "dst_ip", "dst_port")
    keyed = packets.withColumn("key", F.concat_ws("|", F.least(mine, other), F.greatest(mine, other), "proto"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, n = None, 0.0, 0.0, 0
        for batch in batches:
            keys, times, numbers = batch.column("key").to_pylist(), batch.column("ts").to_pylist(), np.empty(batch.num_rows, np.int32)
            for i, (key, t) in enumerate(zip(keys, times, strict=True)):
                if key != now:
                    now, first, n = key, t, 0
                elif t - last > idle or t - first > active:
                    first, n = t, n + 1
                last, numbers[i] = t, n
            yield batch.append_column("session", pa.array(numbers))

    cut = keyed.repartition("key").sortWithinPartitions("key", "ts", "src_ip", "src_port", "flags").mapInArrow(run, f"{FIELDS}, key string, session int")
    lead = cut.groupBy("key", "session").agg(F.min(F.struct("ts", "flags", "src_ip", "src_port", "dst_ip", "dst_port")).alias("lead"))
    met = cut.join(lead, ["key", "session"])
    out = (c("src_ip") == c("lead.src_ip")) & (c("src_port") == c("lead.src_port"))
    total = lambda cond, what=F.lit(1): F.sum(F.when(cond, what).otherwise(0))
    flag = lambda bits: c("flags").bitwiseAND(F.lit(0x17)) == bits
    seen = lambda name: F.min_by(name, F.when(c(name).isNotNull(), c("ts"))).alias(name)
    sizes = F.transform(F.slice(F.array_sort(F.collect_list(F.when(c("nth") <= 20, F.struct("nth", F.when(out, c("size")).otherwise(-c("size")).alias("s"))))), 1, 20), lambda x: x["s"].cast("int"))
    from pyspark.sql.window import Window

    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("key", "session").orderBy("ts", "src_ip", "src_port", "flags")))
    flows = met.groupBy("key", "session").agg(
        F.first("lead").alias("lead"), F.first("proto").alias("proto"), (F.max("ts") - F.min("ts")).alias("duration"), total(out).alias("pkts_out"), total(~out).alias("pkts_in"), total(out, c("size")).alias("bytes_out"), total(~out, c("size")).alias("bytes_in"),
        total(flag(0x02)).cast("int").alias("syn"), total(flag(0x12)).cast("int").alias("synack"), total(c("flags").bitwiseAND(F.lit(4)) != 0).cast("int").alias("rst"), total(c("flags").bitwiseAND(F.lit(1)) != 0).cast("int").alias("fin"), sizes.alias("pkt_sizes"),
        F.max_by("dns_qname", F.when(c("dns_qname").isNotNull(), c("ts"))).alias("dns_qname"), F.max_by("dns_qtype", F.when(c("dns_qtype").isNotNull(), c("ts"))).alias("dns_qtype"), F.max_by("dns_rcode", F.when(c("dns_rcode").isNotNull(), c("ts"))).alias("dns_rcode"),
        *[seen(n) for n in ("tls_sni", "tls_ja3", "tls_ja4", "tls_self_signed", "tls_cert_days", "ics_proto", "ics_func", "ics_unit", "ics_write", "ics_illegal")],
    )
    lead_cols = [c(f"lead.{n}").alias(n) for n in ("ts", "src_ip", "dst_ip", "src_port", "dst_port")]
    return flows.select(*lead_cols, *[n for n in flows.columns if n not in ("key", "session", "lead")])
