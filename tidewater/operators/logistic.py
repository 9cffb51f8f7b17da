"""Logistic regression: scaler, full-batch fit, scores and attributions as column expressions, threshold choice."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import sigmoid


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    w: tuple[float, ...]
    b: float
    mu: tuple[float, ...]
    sigma: tuple[float, ...]
    threshold: float = 0.5
    extra: dict = field(default_factory=dict, compare=False)

    def terms(self, of: dict[str, Column] | None = None) -> list[Column]:
        """Each feature's part of the logit; a missing feature counts as 0."""
        col = lambda f: F.coalesce((of or {}).get(f, F.col(f)).cast("double"), F.lit(0.0))
        return [F.lit(w) * ((col(f) - F.lit(m)) / F.lit(s)) for f, w, m, s in zip(self.features, self.w, self.mu, self.sigma, strict=True)]

    def probability(self, of: dict[str, Column] | None = None) -> Column:
        total = F.lit(self.b)
        for t in self.terms(of):
            total = total + t
        return sigmoid(total)

    def explain(self, of: dict[str, Column] | None = None, top: int = 4) -> Column:
        """The largest parts of the logit by size: array of (feature, contribution, value)."""
        value = lambda f: F.coalesce((of or {}).get(f, F.col(f)).cast("double"), F.lit(0.0))
        parts = F.array(*[F.struct((-F.abs(t)).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("feature"), F.round(t, 3).alias("contribution"), F.round(value(f), 4).alias("value")) for i, (f, t) in enumerate(zip(self.features, self.terms(of), strict=True))])
        large = F.filter(F.slice(F.array_sort(parts), 1, top), lambda p: p["k"] < -1e-6)
        return F.transform(large, lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution"), p["value"].alias("value")))

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "extra"})

    @staticmethod
    def from_json(text: str) -> Logistic:
        d = json.loads(text)
        return Logistic(*(tuple(d[k]) if isinstance(d[k], list) else d[k] for k in ("features", "w", "b", "mu", "sigma", "threshold")))


def scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: mu_x and sigma_x (sample deviation, 1 where it is 0) of each feature."""
    sd = lambda f: F.coalesce(F.stddev_samp(f), F.lit(0.0))
    return df.agg(*[e for f in features for e in (F.avg(f).alias(f"mu_{f}"), F.when(sd(f) == 0, 1.0).otherwise(sd(f)).alias(f"sigma_{f}"))])


def fit(df: DataFrame, features: list[str], label: str = "y", rate: float = 0.5, epochs: int = 600, l2: float = 1e-3, most_weight: float = 25.0, sample: int = 200_000) -> Logistic:
    """Full-batch gradient descent with class weights, on at most ``sample`` distinct labelled rows.

    Equal rows of a label become one weighted row where they lie. Of those, the ``sample`` least by a hash of their values
    are fitted; means, deviations and class weights come from all rows.
    """
    s = scaler(df, features).first()
    mu = np.array([s[f"mu_{f}"] or 0.0 for f in features])
    sigma = np.array([s[f"sigma_{f}"] or 1.0 for f in features])
    counts = {r["y"]: r["n"] for r in df.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    weight = min(neg / pos, most_weight) if pos else 1.0
    rows = df.groupBy(F.col(label).cast("int").alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).agg(F.count("*").alias("n"))
    kept = rows.orderBy(F.xxhash64("y", *features), "y", *features).limit(sample).toPandas().sort_values(["y", *features])
    z, y, n = (kept[features].to_numpy(float) - mu) / sigma, kept["y"].to_numpy(float), kept["n"].to_numpy(float)
    n = n * np.where(y == 1, weight, 1.0)
    w, b, total = np.zeros(len(features)), 0.0, max(n.sum(), 1e-12)
    for _ in range(epochs):
        error = (1 / (1 + np.exp(-np.clip(z @ w + b, -700, 700))) - y) * n
        b -= rate * error.sum() / total
        w -= rate * (error @ z / total + l2 * w)
    return Logistic(tuple(features), tuple(map(float, w)), float(b), tuple(map(float, mu)), tuple(map(float, sigma)))


def thresholds(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """(t, tp, fp, fn, f1) on the grid 0.05, 0.07 .. 0.99: scores are counted by grid cell first, so rows aren't multiplied."""
    grid = df.sparkSession.createDataFrame([(i / 100.0,) for i in range(5, 100, 2)], "t double")  # 48 rows
    cell = df.groupBy(F.col(score).alias("s"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n"))
    hit = lambda y, over: F.sum(F.when((F.col("y") == y) & (F.col("s") >= F.col("t") if over else F.col("s") < F.col("t")), F.col("n")).otherwise(0))
    counts = cell.crossJoin(F.broadcast(grid)).groupBy("t").agg(hit(1, True).alias("tp"), hit(0, True).alias("fp"), hit(1, False).alias("fn"))
    return counts.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def choose_threshold(df: DataFrame, score: str = "score", label: str = "y") -> float:
    best = thresholds(df, score, label).where("f1 IS NOT NULL").orderBy(F.col("f1").desc(), "t").first()
    return float(best["t"]) if best else 0.5

