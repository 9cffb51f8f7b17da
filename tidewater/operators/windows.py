"""The window clock: tumbling windows anchored at the first flow, and their realignment after a long silence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import scan


def anchored(flows: DataFrame, width: float = 60.0, origin: DataFrame | None = None) -> DataFrame:
    """Add window_end: windows of ``width`` seconds from the first flow's time on; a flow at an end opens the next.

    origin: one row, that time, where it can be had for less than a pass over ``flows``.
    """
    origin = flows.agg(F.min("ts")) if origin is None else origin
    origin = origin.toDF("_origin")
    met = flows.crossJoin(F.broadcast(origin))  # one row
    return met.withColumn("window_end", F.col("_origin") + (F.floor((F.col("ts") - F.col("_origin")) / width) + 1) * width).drop("_origin")


def realigned(flows: DataFrame, width: float = 60.0, idle: int = 10) -> DataFrame:
    """Add window_end, where a flow over ``idle`` widths past the end of the open window becomes a new origin.

    A silence of over ``idle`` widths always ends at the first flow of a time bucket of that length, so buckets carry all
    that matters: their first and last times are folded in order (as many as the time span has buckets, whatever the
    number of flows), each bucket gets its origin, and flows join it by bucket.
    """
    reach = idle * width
    bucket = F.floor(F.col("ts") / reach)
    ends = flows.groupBy(bucket.alias("_bucket")).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))

    def step(state: tuple | None, x: dict) -> tuple[tuple, tuple]:
        origin = x["_lo"]
        if state is not None:
            open_end = state[0] + (math.floor((state[1] - state[0]) / width) + 1) * width
            origin = x["_lo"] if x["_lo"] - open_end > reach else state[0]
        return (origin, x["_hi"]), (origin,)

    origins = scan(ends.where("_bucket IS NOT NULL"), [], ["_bucket"], None, step, "_origin double", ["_lo", "_hi"]).select("_bucket", "_origin")
    met = flows.withColumn("_bucket", bucket).join(origins, "_bucket").drop("_bucket")
    return met.withColumn("window_end", F.col("_origin") + (F.floor((F.col("ts") - F.col("_origin")) / width) + 1) * width).drop("_origin")


def closed_by(last: float, now: float, width: float = 60.0, idle: int = 10) -> tuple[list[float], float]:
    """The ends that a clock without further flows closes by ``now``, and the end that is open then.

    last: the open window's end. Every ended window is closed, with flows or without; after over ``idle`` widths of
    silence only the open one, and the clock starts anew at ``now``.
    """
    if now - last > idle * width:
        return [last], now + width
    n = max(0, math.floor((now - last) / width) + 1)
    return [last + i * width for i in range(n)], last + n * width
