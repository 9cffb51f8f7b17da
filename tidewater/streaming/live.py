"""Structured Streaming forms: windowed fan-out with a watermark, emit-once alerts, flows from a growing folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fusion as N
from ..operators.detectors import Recon

c = F.col


def stream_table(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A growing folder of Parquet files as a stream, ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def recon_stream(flows: DataFrame, cfg: Recon = Recon(), width: float = 60.0, offset: float = 0.0, late: str = "10 minutes") -> DataFrame:
    """The fan-out of each source in tumbling windows, one row when the watermark passes a window's end.

    Flows need event_time (timestamp). ``offset`` moves windows to the origin of a batch run (its first time modulo
    ``width``). Targets are aggregated first and sources second, both in the state store, so state is bounded by the
    targets of open windows. Unlike batch, flows later than the watermark are dropped.
    """
    asked = flows.withWatermark("event_time", late).where((c("proto") == "tcp") & (c("syn") > 0) & (F.coalesce("ics_proto", F.lit("")) == ""))
    at = F.window("event_time", f"{int(width * 1e6)} microseconds", f"{int(width * 1e6)} microseconds", f"{round(offset * 1e6)} microseconds")
    target = asked.groupBy(at.alias("w"), "src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("n"), F.sum((c("synack") <= 0).cast("int")).alias("dead"), F.max(((c("synack") > 0) | (c("bytes_in") > 0)).cast("int")).alias("back"))
    again = F.window(F.window_time("w"), f"{int(width * 1e6)} microseconds", f"{int(width * 1e6)} microseconds", f"{round(offset * 1e6)} microseconds")
    src = target.groupBy(again.alias("w"), "src_ip").agg(F.count("*").alias("targets"), F.sum("n").alias("observed_flows"), F.sum("dead").alias("dead"), (F.max("back") > 0).alias("reverse_visible"))
    src = src.where(c("targets") >= cfg.min_targets).withColumn("unanswered", c("dead") / c("observed_flows"))
    seen = F.when(c("unanswered") >= cfg.unanswered, F.least(c("targets") / 300.0, F.lit(1.0)) * 0.55 + c("unanswered") * 0.45)
    blind = F.when(c("targets") >= cfg.min_targets * 1.5, F.least(c("targets") / 250.0, F.lit(1.0)) * 0.70)
    return src.select((F.unix_micros("w.end") / 1e6).alias("window_end"), "src_ip", "targets", "observed_flows", "reverse_visible", "unanswered", F.when(c("reverse_visible"), seen).otherwise(blind).alias("score"))


def emit_once(alerts: DataFrame, span: float = 300.0, ttl: str = "1 hour") -> DataFrame:
    """Alerts (threat_class, src_ip, dst_ip, window_end, score) of which none was emitted within ``span`` seconds before.

    One double of state a key, dropped after ``ttl`` without an alert; as ``ttl`` exceeds ``span``, that changes nothing.
    """
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else float("-inf"), []
        for row in pd.concat(list(rows)).sort_values("window_end").itertuples():
            if row.window_end - last >= span:
                last = row.window_end
                out.append((*key, row.window_end, row.score))
        state.update((last,))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["threat_class", "src_ip", "dst_ip", "window_end", "score"])

    keys = alerts.select("threat_class", "src_ip", "dst_ip", "window_end", "score").groupBy("threat_class", "src_ip", "dst_ip")
    return keys.applyInPandasWithState(step, "threat_class string, src_ip string, dst_ip string, window_end double, score double", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_ledger(alerts: DataFrame, path: str, order: list[str], body: str, on_alert: Callable[[dict], None] | None = None) -> DataStreamWriter:
    """A writer that chains each trigger's alerts on to the ledger at ``path``, and tells ``on_alert`` of each.

    Each trigger has its own folder, which a trigger that is run again after a failure overwrites, so nothing is chained
    twice; it may be told twice. ``on_alert`` is called on the driver, one alert at a time.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        last = (0, N.GENESIS)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            last = tuple(N.resume(spark.read.parquet(path).where(c("trigger") < number)).first())
        kept = batch.persist()
        if not kept.isEmpty():
            N.chain(kept, order, body, last).write.mode("overwrite").parquet(f"{path}/trigger={number}")
            if on_alert:
                for row in kept.orderBy(*order).toLocalIterator():
                    on_alert(row.asDict())
        kept.unpersist()

    return alerts.writeStream.foreachBatch(each)
