"""How the engine holds up when attacks or taps change: a row a setting, each a run over synthetic flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import evaluation as E
from ..operators import windows as W
from ..sources import synthetic
from . import engine

c = F.col


def jitter_sweep(spark: SparkSession, jitters: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), seeds: tuple[int, ...] = (1, 2, 3), count: int = 20_000, cfg: D.Beacon = D.Beacon()) -> DataFrame:
    """(jitter, beacons, found, recall): labelled beacons and those that the beacon detector names, over all seeds."""
    parts = []
    for jitter in jitters:
        for seed in seeds:
            flows = W.anchored(synthetic.flows(spark, count, seed, jitter=jitter), cfg.width)
            planted = flows.where("label = 'c2_beaconing'").select("src_ip", "dst_ip").distinct()
            named = D.beacon(flows, cfg).select("src_ip", "dst_ip").distinct().withColumn("hit", F.lit(1))
            parts.append(planted.join(named, ["src_ip", "dst_ip"], "left").select(F.lit(jitter).alias("jitter"), F.coalesce("hit", F.lit(0)).alias("hit")))
    rows = reduce(DataFrame.unionAll, parts)
    return rows.groupBy("jitter").agg(F.count("*").alias("beacons"), F.sum("hit").alias("found"), F.avg("hit").alias("recall"))


def degraded(spark: SparkSession, seeds: tuple[int, ...] = (1, 2), count: int = 20_000, cfg: engine.Config = engine.Config()) -> DataFrame:
    """(seed, threat_class, both, one_way, kept): what a tap of one direction still sees of each class."""
    parts = []
    for seed in seeds:
        flows = synthetic.flows(spark, count, seed)
        both, one = (engine.run(flows, engine.Config(**{**cfg.__dict__, "one_way": x}))["raised"] for x in (False, True))
        parts.append(engine.retention(both, one).withColumn("seed", F.lit(seed)))
    return reduce(DataFrame.unionAll, parts)


def host_scores(spark: SparkSession, seeds: tuple[int, ...] = (1, 2), count: int = 20_000, cfg: engine.Config = engine.Config()) -> DataFrame:
    """(seed, tp, fp, fn, precision, recall, f1) over hosts: truth by label against what any alert names."""
    parts = []
    for seed in seeds:
        got = engine.run(synthetic.flows(spark, count, seed), cfg)
        parts.append(E.host_detection(E.host_truth(got["flows"]), E.host_prediction(got["raised"])).withColumn("seed", F.lit(seed)))
    return reduce(DataFrame.unionAll, parts)
