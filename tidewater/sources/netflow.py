"""NetFlow version 5: export datagrams to flows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, duration double, pkts_out bigint, bytes_out bigint, syn int, synack int, rst int, fin int"
_ROW = np.dtype([("src", ">u4"), ("dst", ">u4"), ("hop", ">u4"), ("if", ">u2", 2), ("pkts", ">u4"), ("bytes", ">u4"), ("first", ">u4"), ("last", ">u4"), ("sport", ">u2"), ("dport", ">u2"), ("pad", "u1"), ("flags", "u1"), ("proto", "u1"), ("rest", "u1", 9)])


def _dotted(v: np.ndarray) -> list[str]:
    return [f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}" for x in v.tolist()]


def decode(datagrams: DataFrame, column: str = "datagram") -> DataFrame:
    """A row per TCP or UDP record of each version 5 datagram; other or cut-off datagrams give what is whole of them.

    Records are read as one structured array a datagram. Times are on the exporter's clock: its wall clock less its
    uptime, plus the record's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for raw in batch.column(0).to_pylist():
                if raw is None or len(raw) < 24:
                    continue
                version, count, uptime, secs, nanos, _ = struct.unpack_from("!HHIIII", raw)
                n = min(count, (len(raw) - 24) // 48)
                if version == 5 and n:
                    rows = np.frombuffer(raw, _ROW, n, 24)
                    parts.append((rows[np.isin(rows["proto"], (6, 17))], secs + nanos / 1e9 - uptime / 1000.0))
            rows = np.concatenate([p for p, _ in parts]) if parts else np.empty(0, _ROW)
            boot = np.concatenate([np.full(len(p), b) for p, b in parts]) if parts else np.empty(0)
            flag = lambda bits: ((rows["flags"] & bits) == bits).astype(np.int32) * (rows["proto"] == 6)  # noqa: B023, E731
            spent = np.maximum(rows["last"].astype(float) - rows["first"].astype(float), 0) / 1000.0
            columns = [
                boot + rows["first"] / 1000.0, _dotted(rows["src"]), _dotted(rows["dst"]), rows["sport"].astype(np.int32), rows["dport"].astype(np.int32), np.where(rows["proto"] == 6, "tcp", "udp").tolist(), spent,
                rows["pkts"].astype(np.int64), rows["bytes"].astype(np.int64), flag(0x02), flag(0x12), flag(0x04), flag(0x01),
            ]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            kinds = {"double": pa.float64(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(x, kinds[f.split()[1]]) for x, f in zip(columns, SCHEMA.split(", "), strict=True)], names=names)

    return datagrams.select(column).mapInArrow(run, SCHEMA)
