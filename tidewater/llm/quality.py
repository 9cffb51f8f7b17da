"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import mod_crc, sliced

#: Most labelled rows that a model is fitted on: the least by a hash of their id.
SAMPLE = 8192

_CLASSES = np.full(256, 4)
_CLASSES[[9, 10, 11, 12, 13, 32]] = 0
_CLASSES[65:91] = 1
_CLASSES[97:123] = 2
_CLASSES[48:58] = 3
_CLASSES[128:] = 5
_MARKS = np.frombuffer(b".,!?|#*$%&\"'-:;=<>{}()/\\", np.uint8)
NUMBERS = 14 + len(_MARKS) + 1


def statistics(text: str | None) -> np.ndarray:
    """The numbers that the trees see, of a whole text; zeros for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(NUMBERS, np.float64)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    shares = np.bincount(_CLASSES, counts, minlength=6) / n
    many, kinds = max(len(words), 1), len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[:14] = [np.log1p(n), np.log1p(len(words)), *shares, lengths.mean(), lengths.std(), kinds / np.sqrt(many), pairs / max(many - 1, 1), len(set(lines)) / len(lines), len(lines) / many]
    out[14:-1] = counts[_MARKS] / many
    out[-1] = counts.max() / n
    return out


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth, level by level in flat arrays: a row's path is index arithmetic for all trees at once."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        at, every, rows = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(inner.bit_length()):
            at = 2 * at + 1 + (x[rows, self.feature[every, at]] > self.threshold[every, at])
        return self.base + self.leaf[every, at - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 8) -> Forest:
    """Fit to labels 0 and 1. Features are cut at quantiles into ``bins``; splits maximise the gain of gradient histograms.

    Without rows, or with one class only, the forest is empty and scores the share of label 1 (0.5 without rows).
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    flat = binned + np.arange(x.shape[1]) * bins
    features, thresholds, leaves, margin = [], [], [], np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range((1 << level) - 1, (2 << level) - 1):
                mine = np.flatnonzero(node == k)
                if len(mine) >= 2 * least:
                    where = flat[mine]
                    size = x.shape[1] * bins
                    hist = [np.bincount(where.ravel(), np.repeat(v[mine], x.shape[1]), size).reshape(-1, bins).cumsum(1) for v in (g, h, np.ones(len(y)))]
                    gl, hl, nl = hist
                    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    gain[(nl < least) | (nt - nl < least)] = 0
                    f, b = divmod(int(gain.argmax()), bins)
                    if gain[f, b] > 1e-9 and b < len(edges[f]):
                        feature[k], threshold[k] = f, edges[f][b]
                node[mine] = 2 * k + 1 + (x[mine, feature[k]] > threshold[k])
        node -= inner
        leaf = -rate * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + l2)
        margin += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), base)


def _measured(df: DataFrame, *names: str) -> DataFrame:
    """``names`` and x, the statistics of ``text``; texts are not kept."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [statistics(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, pa.list_(pa.float64()))], names=[*names, "x"])

    return df.select(*names, "text").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", x array<double>")


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled rows, the least by a hash of their id (a repeated row counts once); rows of a null id or label are left out."""
    ids = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    chosen = ids.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _measured(texts.join(F.broadcast(chosen), "id"), "id", "y").groupBy("id", "y").agg(F.min("x").alias("x")).orderBy("id", "y").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), NUMBERS)
    return boost(x, rows["y"].to_numpy(np.float64))


def score(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), and the columns ``keep``, one row per input row.

    A null or empty text has all statistics zero and a score like any other. Null ids and repeated rows are kept; equal texts
    have equal scores. Columns of ``keep`` named like a result's are called k0, k1, ...; an empty table gives an empty result.
    A text is held whole, with a list of its words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            scores = forest.score(np.array([statistics(t) for t in texts]).reshape(len(texts), NUMBERS))
            kept = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *kept], names=["doc_id", "score", "predicted", *names])

    names = [f"k{i}" for i in range(len(keep))]
    kinds = dict(df.dtypes)
    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)])
    out = given.mapInArrow(run, "doc_id long, score double, predicted int" + "".join(f", {n} {kinds[k]}" for n, k in zip(names, keep, strict=True)))
    return out.select("doc_id", "score", "predicted", *[F.col(n).alias(k if k not in ("doc_id", "score", "predicted") else n) for n, k in zip(names, keep, strict=True)])


def held_out(id_col: str, folds: int, fold: int):
    """Whether a row's id, as text, falls into the fold that no label is learned from; a null id doesn't."""
    return F.coalesce(mod_crc(id_col, folds) == fold, F.lit(False))
