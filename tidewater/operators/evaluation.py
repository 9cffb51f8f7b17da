"""Calibration, rank statistics, splits and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col


def placed(df: DataFrame, order: list[str | Column], out: str = "place") -> DataFrame:
    """Add the row's place (from 1) in a global order, without one task for all rows.

    Rows are range-partitioned and sorted; each partition's count is aggregated, and its rows get the sum of the counts
    before plus their place inside.
    """
    cols = [c(o) if isinstance(o, str) else o for o in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_id", 33), "_row": c("_id").bitwiseAND(F.lit((1 << 33) - 1))}).persist()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(out, c("_before") + c("_row") + 1).drop("_id", "_part", "_row", "_before")


def nearest_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(p, value): sorted value at round(p * (n - 1)), halves to even, from counts of distinct values."""
    counts = df.where(c(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return _at(counts, value, [(p, F.least(F.bround(F.lit(p) * (c("total") - 1), 0), c("total") - 1)) for p in shares])


def floor_rank(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(p, value): sorted value at floor(n * p), at most the last."""
    counts = df.where(c(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return _at(counts, value, [(p, F.least(F.floor(c("total") * F.lit(p)), c("total") - 1)) for p in shares])


def _at(counts: DataFrame, value: str, wanted: list[tuple[float, Column]]) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))  # one row
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(total))
    asked = upto.withColumn("w", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), i.cast("bigint").alias("i")) for p, i in wanted])))
    return asked.where(c("upto") > c("w.i")).groupBy(c("w.p").alias("p")).agg(F.min(value).alias(value))


def temporal_split(df: DataFrame, order: list[str], share: float = 0.7) -> DataFrame:
    """Add train: whether the row is among the first floor(n * share) in time order."""
    total = df.agg(F.floor(F.count("*") * F.lit(share)).alias("_cut"))
    return placed(df, order).crossJoin(F.broadcast(total)).withColumn("train", c("place") <= c("_cut")).drop("place", "_cut")


def calibration(df: DataFrame, score: str = "score", label: str = "y", bins: int = 10, smoothing: float = 1.0) -> DataFrame:
    """(bin, edge, value): equal counts in score order, smoothed precision, running maximum."""
    n = df.agg(F.greatest(F.floor(F.count("*") / bins), F.lit(1)).alias("_size"))
    rows = placed(df.select(c(score).alias("s"), c(label).cast("int").alias("y")), ["s", "y"]).crossJoin(F.broadcast(n))
    per = rows.groupBy(F.floor((c("place") - 1) / c("_size")).alias("bin")).agg(F.min("s").alias("edge"), ((F.sum("y") + smoothing) / (F.count("*") + 2 * smoothing)).alias("v"))
    return per.select("bin", "edge", F.max("v").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and fpr of each class, from the confusion counts."""
    m = confusion(df, truth, predicted)
    hit = m.where(c(truth) == c(predicted)).select(c(truth).alias("cls"), c("n").alias("tp"))
    row = m.groupBy(c(truth).alias("cls")).agg(F.sum("n").alias("actual"))
    col = m.groupBy(c(predicted).alias("cls")).agg(F.sum("n").alias("said"))
    met = row.join(col, "cls", "full").join(hit, "cls", "left").na.fill(0)
    out = met.select("cls", "tp", (c("said") - c("tp")).alias("fp"), (c("actual") - c("tp")).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = m.agg(F.sum("n").alias("_all"))  # one row
    rest = c("_all") - c("tp") - c("fn")
    out = out.crossJoin(F.broadcast(total)).withColumn("fpr", share(c("fp"), rest)).drop("_all")
    return out.withColumns({"precision": share(c("tp"), c("tp") + c("fp")), "recall": share(c("tp"), c("tp") + c("fn")), "f1": share(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))})


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return per_class(df, truth, predicted).agg(F.avg("f1").alias("macro_f1"))


def binary(df: DataFrame, label: str = "y", fired: str = "fired") -> DataFrame:
    """accuracy, precision, recall, f1, fpr in one row."""
    k = lambda y, f: F.sum(((c(label) == y) & (c(fired) == f)).cast("int"))
    m = df.agg(k(1, True).alias("tp"), k(0, True).alias("fp"), k(0, False).alias("tn"), k(1, False).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (c(x) for x in ("tp", "fp", "tn", "fn"))
    return m.select("tp", "fp", "tn", "fn", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fp, fp + tn).alias("fpr"))


def ece_brier(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    at = F.least(F.floor(c(confidence) * bins), F.lit(bins - 1))
    per = df.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.avg(confidence).alias("conf"), F.avg(c(correct).cast("double")).alias("acc"), F.sum(F.pow(c(confidence) - c(correct).cast("double"), F.lit(2.0))).alias("sq"))
    return per.agg((F.sum(c("n") * F.abs(c("conf") - c("acc"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"))


def recall_at_fpr(df: DataFrame, fpr: float, score: str = "score", label: str = "y") -> DataFrame:
    """threshold (the score at round((1 - fpr) * n) of the negatives, halves to even) and the recall over it."""
    negatives = df.where(c(label) == 0).select(c(score).alias("s"))
    counts = negatives.groupBy("s").agg(F.count("*").alias("n"))
    cut = _at(counts, "s", [(fpr, F.least(F.bround((1.0 - fpr) * c("total"), 0), c("total") - 1))]).select(c("s").alias("threshold"))
    return df.where(c(label) == 1).crossJoin(F.broadcast(cut)).agg(F.max("threshold").alias("threshold"), F.avg((c(score) > c("threshold")).cast("double")).alias("recall"))


def auc(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Area under the ROC curve by rank sums, ties sharing their mean rank; distinct scores are ranked, not rows."""
    per = df.groupBy(c(score).alias("s")).agg(F.sum((c(label) == 1).cast("bigint")).alias("p"), F.count("*").alias("n"))
    upto = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = upto.agg(F.sum(c("p") * (c("before") + (c("n") + 1) / 2.0)).alias("r"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return ranked.select(((c("r") - c("p") * (c("p") + 1) / 2) / (c("p") * (c("n") - c("p")))).alias("auc"))


def host_truth(flows: DataFrame, flood_target: str | None = None) -> DataFrame:
    """(host, classes): the classes of each source's labelled flows; beaconing implies an encrypted session; a flood counts for its target."""
    bad = flows.where(c("label") != "benign")
    host = F.when(c("label") == "volumetric_ddos", F.coalesce(F.lit(flood_target), c("dst_ip"))).otherwise(c("src_ip"))
    both = F.when(c("label") == "c2_beaconing", F.array(F.lit("c2_beaconing"), F.lit("encrypted_malware"))).otherwise(F.array("label"))
    return bad.select(host.alias("host"), F.explode(both).alias("k")).distinct().groupBy("host").agg(F.array_sort(F.collect_list("k")).alias("classes"))


def host_prediction(alerts: DataFrame) -> DataFrame:
    """(host, classes, primary): what was raised for each host; primary: the class of the highest confidence, then by name."""
    host = F.when(c("threat_class") == "volumetric_ddos", c("dst_ip")).otherwise(c("src_ip"))
    best = alerts.groupBy(host.alias("host"), "threat_class").agg(F.max("confidence").alias("conf"))
    return best.groupBy("host").agg(F.array_sort(F.collect_list("threat_class")).alias("classes"), F.min_by("threat_class", F.struct(-c("conf"), c("threat_class"))).alias("primary"))


def alert_correct(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    host = F.when(c("threat_class") == "volumetric_ddos", c("dst_ip")).otherwise(c("src_ip"))
    met = alerts.withColumn("host", host).join(truth.withColumnRenamed("classes", "_truth"), "host", "left")
    return met.withColumn("correct", F.coalesce(F.array_contains("_truth", c("threat_class")), F.lit(False))).drop("_truth")


def host_detection(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """One row over hosts (column host of both): tp, fp, fn, precision, recall and f1 of being named at all."""
    both = truth.select("host", F.lit(1).alias("bad")).join(prediction.select("host", F.lit(1).alias("named")), "host", "full").na.fill(0)
    k = lambda bad, named: F.coalesce(F.sum(((c("bad") == bad) & (c("named") == named)).cast("bigint")), F.lit(0))
    m = both.agg(k(1, 1).alias("tp"), k(0, 1).alias("fp"), k(1, 0).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = c("tp"), c("fp"), c("fn")
    return m.select("tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def engine_stats(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: flows, windows, alerts, alerts a million flows, flows a second of traffic, and nearest-rank latencies."""
    counts = flows.agg(F.count("*").alias("flows"), F.count_distinct("window_end").alias("windows"), (F.max("ts") - F.min("ts")).alias("_span"))
    lat = nearest_rank(alerts, "latency_ms", [0.5, 0.95, 0.99]).groupBy().pivot("p", [0.5, 0.95, 0.99]).agg(F.first("latency_ms"))
    named = lat.select(c("`0.5`").alias("p50_ms"), c("`0.95`").alias("p95_ms"), c("`0.99`").alias("p99_ms"))
    met = counts.crossJoin(F.broadcast(alerts.agg(F.count("*").alias("alerts")))).crossJoin(F.broadcast(named))  # one row each
    rates = {"alerts_per_million": c("alerts") * 1e6 / F.greatest("flows", F.lit(1)), "flows_per_second": F.when(c("_span") > 0, c("flows") / c("_span"))}
    return met.withColumns(rates).drop("_span")
