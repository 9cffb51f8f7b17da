"""Unsupervised scoring: isolation forest, autoencoder, envelopes, and the anomaly detector."""

from __future__ import annotations

import json
import math
import random
from collections import deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as X
from ..schema import CAVEATS
from .folds import relay

c = F.col
EULER = 0.5772156649015329


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search over n points; 1 for one point or none."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n <= 1, 1.0, 2.0 * (np.log(safe - 1) + EULER) - 2.0 * (safe - 1) / safe)


@dataclass(frozen=True)
class Forest:
    """Trees as one node table: feature (-1: leaf), cut, children, size, and each tree's root."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    roots: np.ndarray
    sample_size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), all rows and trees stepping down together."""
        if not len(self.roots):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node, depth = np.full(len(x), root), np.zeros(len(x))
            while True:
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                below = x[rows[inner], self.feature[at]] < self.cut[at]
                node[inner] = np.where(below, self.left[at], self.right[at])
                depth[inner] += 1
            total += depth + expected_path(self.size[node])
        return 2.0 ** (-(total / len(self.roots)) / float(expected_path(self.sample_size)))

    def to_json(self) -> str:
        return json.dumps({k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in self.__dict__.items()})

    @staticmethod
    def from_json(text: str) -> Forest:
        d = json.loads(text)
        whole = {"feature", "left", "right", "size", "roots"}
        return Forest(**{k: (np.array(v, np.int64 if k in whole else float) if isinstance(v, list) else v) for k, v in d.items()})

    def nodes(self, df: DataFrame) -> DataFrame:
        """The node table as a DataFrame, for scoring in SQL."""
        rows = [(int(i), int(f), float(q), int(a), int(b), int(s)) for i, (f, q, a, b, s) in enumerate(zip(self.feature, self.cut, self.left, self.right, self.size, strict=True))]
        return df.sparkSession.createDataFrame(rows, "node int, feature int, cut double, l int, r int, size int")


def fit_forest(x: np.ndarray, trees: int = 100, sample_size: int = 256, seed: int = 7) -> Forest:
    """Each tree from a sample: at a node the first varying feature of a shuffle, cut uniformly."""
    rng, parts = random.Random(seed), ([], [], [], [], [])
    if not len(x):
        return Forest(*(np.zeros(0, np.int64) for _ in range(6)), sample_size)
    m = min(sample_size, len(x))
    limit, roots = math.ceil(math.log2(max(m, 2))), []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(parts[0])
        for part, value in zip(parts, (-1, 0.0, -1, -1, len(rows)), strict=True):
            part.append(value)
        if depth < limit and len(rows) > 1:
            order = list(range(x.shape[1]))
            rng.shuffle(order)
            for f in order:
                low, high = rows[:, f].min(), rows[:, f].max()
                if high > low:
                    cut = rng.uniform(low, high)
                    under = rows[:, f] < cut
                    parts[0][at], parts[1][at] = f, cut
                    parts[2][at] = grow(rows[under], depth + 1)
                    parts[3][at] = grow(rows[~under], depth + 1)
                    break
        return at

    for _ in range(trees):
        pick = rng.sample(range(len(x)), m) if len(x) > m else range(len(x))
        roots.append(grow(x[list(pick)], 0))
    kinds = (np.int64, float, np.int64, np.int64, np.int64)
    return Forest(*(np.array(p, k) for p, k in zip(parts, kinds, strict=True)), np.array(roots, np.int64), sample_size)


def forest_of(df: DataFrame, vector: str, key: str, trees: int = 100, sample_size: int = 256, seed: int = 7, pool: int = 20_000) -> Forest:
    """Fit on a bounded pool of rows, the least by a hash of their key (``pool``), from which each tree draws its sample."""
    rows = df.where(c(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).limit(pool).select(vector).collect()
    return fit_forest(np.array([r[0] for r in rows], float).reshape(len(rows), -1), trees, sample_size, seed)


def forest_score(df: DataFrame, forest: Forest, vector: str, out: str = "score") -> DataFrame:
    """Add the forest's score of an array<double> column, in Arrow batches."""

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        return pd.Series(forest.score(x.astype(float)))

    return df.withColumn(out, score(c(vector).cast("array<double>")))


class Autoencoder:
    """dim-16-8-16-dim, tanh and a linear end, mean squared error, minibatches with momentum; numpy."""

    def __init__(self, dim: int, hidden: int = 16, bottleneck: int = 8, seed: int = 1337):
        rng, sizes = np.random.default_rng(seed), [dim, hidden, bottleneck, hidden, dim]
        self.w = [rng.uniform(-1, 1, (b, a)) * math.sqrt(1 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(n) for n in sizes[1:]]
        self.mean, self.scale = np.zeros(dim), np.ones(dim)

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = acts[-1] @ w.T + b
            acts.append(z if i == len(self.w) - 1 else np.tanh(z))
        return acts

    def fit(self, rows: np.ndarray, epochs: int = 12, rate: float = 0.05, batch: int = 32, momentum: float = 0.9, seed: int = 1337) -> Autoencoder:
        self.mean, self.scale = rows.mean(0), 1 / np.sqrt(rows.var(0) + 1e-9)
        x, rng = (rows - self.mean) * self.scale, np.random.default_rng(seed)
        vw, vb = [np.zeros_like(w) for w in self.w], [np.zeros_like(b) for b in self.b]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = x[order[i : i + batch]]
                acts = self._forward(part)
                delta = 2 * (acts[-1] - part) / part.shape[1] / len(part)
                for k in range(len(self.w) - 1, -1, -1):
                    gw, gb = delta.T @ acts[k], delta.sum(0)
                    delta = (delta @ self.w[k]) * (1 - acts[k] ** 2) if k else delta
                    vw[k], vb[k] = momentum * vw[k] - rate * gw, momentum * vb[k] - rate * gb
                    self.w[k], self.b[k] = self.w[k] + vw[k], self.b[k] + vb[k]
        return self

    def error(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.mean) * self.scale
        return ((self._forward(x)[-1] - x) ** 2).mean(1)

    def threshold_at_fpr(self, normal: np.ndarray, fpr: float) -> float:
        errors = np.sort(self.error(normal))
        return float(errors[min(len(errors) - 1, round((1 - fpr) * len(errors)))]) if len(errors) else 0.0


def autoencoder_of(df: DataFrame, vector: str, key: str, pool: int = 20_000, **fit: int) -> Autoencoder:
    """Fit on a bounded pool of rows, the least by a hash of their key. Without rows the net stays as it was drawn."""
    rows = df.where(c(vector).isNotNull()).orderBy(F.xxhash64(F.lit(3), key), key).limit(pool).select(vector).collect()
    if not rows:
        return Autoencoder(1)
    x = np.array([r[0] for r in rows], float)
    return Autoencoder(x.shape[1]).fit(x, **fit)


def autoencoder_score(df: DataFrame, net: Autoencoder, vector: str, out: str = "error") -> DataFrame:
    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(net.error(np.stack(v.to_numpy()).astype(float)) if len(v) else np.zeros(0))

    return df.withColumn(out, score(c(vector).cast("array<double>")))


# -- the detector -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Anomaly:
    score_floor: float = 0.62
    local_excess: float = 0.35
    trained_excess: float = 0.25
    continuous: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
    warmup: int = 150
    memory: int = 3000
    refresh: int = 128
    horizon: float = 1800.0
    fresh: float = 120.0
    min_hits: int = 8
    threshold: float = 0.5


def effective(score: Column, excess: Column, cfg: Anomaly = Anomaly()) -> Column:
    """The forest's score, or more for what lies far outside the trained envelope."""
    far = F.when(excess >= cfg.trained_excess, F.least(0.62 + (excess - cfg.trained_excess) * 0.2, F.lit(0.95))).otherwise(0.0)
    return F.greatest(score, far)


def excess(vector: Column, low: list[float], high: list[float], at: tuple[int, ...]) -> Column:
    """How far the worst of some components lies outside its envelope."""
    return F.greatest(F.lit(0.0), *[x for i, lo, hi in zip(at, low, high, strict=True) for x in (vector[i] - hi, lo - vector[i])])


def profile(df: DataFrame, vector: str, at: tuple[int, ...], low: float = 0.001, high: float = 0.999) -> tuple[list[float], list[float]]:
    """The trained envelope: floor-rank percentiles of each component, one pass a component over distinct values."""
    from .evaluation import floor_rank

    ends = [dict(map(tuple, floor_rank(df.select(c(vector)[i].alias("v")), "v", [low, high]).collect())) for i in at]
    return [e[low] for e in ends], [e[high] for e in ends]


def anomaly_hits_exact(scored: DataFrame, cfg: Anomaly = Anomaly()) -> DataFrame:
    """(seq, hit) with the adaptive local envelope, which each flow's own verdict feeds: one ordered pass over all flows.

    The feedback makes this sequential by definition: parts of the order are sorted and folded one after the other, in memory
    bounded by a part and ``memory`` vectors. Input: seq, ts, v (vector), s (effective score), known (recognised service).
    """
    at = list(cfg.continuous)

    def fold(state: tuple, batches: Iterator[pa.RecordBatch]) -> Generator[pa.RecordBatch, None, tuple]:
        held, low, high, since = state
        local: deque = deque(held, cfg.memory)
        for batch in batches:
            out = []
            v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            for vec, s, known in zip(v, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if known:
                    local.append(vec)
                    out.append(False)
                    continue
                over = float(np.maximum(np.maximum(vec - high, low - vec), 0).max()) if low is not None else 0.0
                hit = s >= cfg.score_floor and low is not None and over >= cfg.local_excess
                out.append(hit)
                if not hit:
                    local.append(vec)
                    since += 1
                    if (low is None and len(local) >= cfg.warmup) or (low is not None and since >= cfg.refresh):
                        col = np.sort(np.array(local), 0)
                        low, high, since = col[int(len(col) * 0.01)], col[min(int(len(col) * 0.99), len(col) - 1)], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], names=["seq", "hit"])
        return list(local), low, high, since

    rows = scored.select("seq", F.array(*[c("v")[i] for i in at]).alias("v"), "s", "known", "ts")
    return relay(rows, ["ts", "seq"], ["seq", "v", "s", "known"], ([], None, None, 0), fold, "seq long, hit boolean")


def anomaly_hits(scored: DataFrame, cfg: Anomaly = Anomaly()) -> DataFrame:
    """As ``anomaly_hits_exact`` with the envelope frozen in each window to that of all flows of the windows before it."""
    rows = scored.select("window_end", *[c("v")[i].alias(f"v{i}") for i in cfg.continuous])
    cell = [F.round(c(f"v{i}"), 2).alias(f"v{i}") for i in cfg.continuous]
    counts = rows.select("window_end", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in zip(cfg.continuous, cell, strict=True)])).alias("e")).groupBy("window_end", c("e.i").alias("i"), c("e.x").alias("x")).agg(F.count("*").alias("n"))
    ends = scored.select(c("window_end").alias("at")).distinct()
    past = counts.join(ends, c("window_end") < c("at")).groupBy("at", "i", "x").agg(F.sum("n").alias("n"))
    from pyspark.sql.window import Window

    order = Window.partitionBy("at", "i").orderBy("x")
    upto = past.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("at", "i"))}).where(c("total") >= cfg.warmup)
    edge = lambda share: F.min(F.when(c("upto") > F.least(F.floor(c("total") * share), c("total") - 1), c("x")))
    env = upto.groupBy("at", "i").agg(edge(0.01).alias("lo"), edge(0.99).alias("hi"))
    env = env.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("lo", "hi")))).alias("env"))
    met = scored.join(env, c("window_end") == c("at"), "left")
    bound = lambda i: F.element_at("env", F.lit(i))
    over = F.greatest(F.lit(0.0), *[x for i in cfg.continuous for x in (c("v")[i] - bound(i)["hi"], bound(i)["lo"] - c("v")[i])])
    hit = (c("s") >= cfg.score_floor) & ~c("known") & c("env").isNotNull() & (over >= cfg.local_excess)
    return met.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("env", "at")


def anomalies(hits: DataFrame, cfg: Anomaly = Anomaly(), width: float = 60.0) -> DataFrame:
    """Sources with enough recent hits at a window end. Input: hits of flows with window_end, ts, seq, src_ip, dst_ip, s."""
    mine = hits.where("hit")
    last = hits.agg(F.max("window_end").alias("_last"))
    steps = F.least(F.floor((c("ts") + cfg.horizon - c("window_end")) / width), F.round((c("_last") - c("window_end")) / width)).cast("int")
    served = mine.crossJoin(F.broadcast(last)).where(steps >= 0).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: c("window_end") + i * width)))
    src = served.groupBy(c("at").alias("window_end"), "src_ip").agg(F.count("*").alias("n"), F.max("s").alias("top"), F.max("ts").alias("ts_event"), F.max_by("dst_ip", F.struct("s", "ts", "seq")).alias("dst_ip"))
    src = src.where((c("n") >= cfg.min_hits) & (c("ts_event") >= c("window_end") - cfg.fresh))
    part = F.least(F.greatest((c("top") - 0.6) / 0.05, F.lit(0.0)), F.lit(1.0)) * 0.45 + F.least(c("n") / 20.0, F.lit(1.0)) * 0.45
    src = src.withColumns({"score": F.least(part, F.lit(0.9)), "threat_class": F.lit("anomalous_traffic"), "observed_flows": c("n"), "evidence": F.to_json(F.struct("n", "top"))})
    src = src.withColumns({"reverse_direction_visible": F.lit(True), "caveat": F.lit(CAVEATS["novel"])})
    return src.where(c("score") >= cfg.threshold).select("window_end", "threat_class", "src_ip", "dst_ip", "score", "ts_event", "observed_flows", "evidence", "reverse_direction_visible", "caveat")


def scored(flows: DataFrame, forest: Forest, low: list[float], high: list[float], cfg: Anomaly = Anomaly()) -> DataFrame:
    """Flows with v, s and known, ready for either form of ``anomaly_hits``."""
    with_v = forest_score(flows.withColumn("v", F.array(*X.anomaly_vector())), forest, "v", "forest")
    return with_v.withColumns({"s": effective(c("forest"), excess(c("v"), low, high, cfg.continuous), cfg), "known": X.is_service_name(F.coalesce("tls_sni", F.lit("")))})
