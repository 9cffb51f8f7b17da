"""SimHash fingerprints and near-duplicate groups through one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import components, join_on_hot_key, written

_OFFSETS = (np.arange(8) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_SHIFTS = np.arange(64, dtype=np.uint64).reshape(8, 8)

#: A bucket of fingerprints up to this size is linked inside one task (half a MB of longs). Larger ones are cut by
#: further variants, whose buckets leave 18 of 64 bits free and so hold at most 2**18 fingerprints.
BUCKET = 65_536


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; the whole sequence if it is shorter; empty if no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(2048, np.int64)
    for part in range(0, len(hashes), 65_536):  # bounded memory for very long texts
        octets = hashes[part : part + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _OFFSETS).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BITS
    return int(np.bitwise_or.reduce(np.where(2 * ones > len(hashes), np.uint64(1) << _SHIFTS, np.uint64(0)).ravel()))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a long; equal texts share work inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(1).to_pylist(), {}
            for text in texts:
                if text not in known:
                    known[text] = majority_bits(shingle_hashes(text, size))
            values = np.array([known[t] for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs(fps: np.ndarray, keys: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``distance`` bits among rows of equal ``keys`` (sorted), of groups of ``most`` rows at most."""
    a, b = [], []
    for step in range(1, most):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        same = same[np.bitwise_count(fps[same] ^ fps[same + step]) <= distance]
        a.append(same)
        b.append(same + step)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def link_bucket(fps: np.ndarray, distance: int, free: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of a bucket's distinct fingerprints within ``distance`` (3 at most) as all pairs would.

    free: lowest bit and width of the part in which pairs still may differ by up to ``distance``. A large bucket is cut
    again by one-wildcard variants of the halves of that part instead of comparing all its pairs.
    """
    low, width = free
    if len(fps) <= 256 or width <= 8:
        return _pairs(fps, np.zeros(len(fps), np.int8), distance, len(fps))
    a, b, half = [], [], width // 2
    for part in (low, low + half):
        value = (fps >> np.uint64(part)) & np.uint64((1 << half) - 1)
        for bit in range(half):
            keys = value & ~(np.uint64(1) << np.uint64(bit))
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
            sizes = np.diff(cuts)
            small = np.repeat(sizes <= 256, sizes)
            x, y = _pairs(fps[order[small]], ordered[small], distance, 256)
            a.append(order[small][x])
            b.append(order[small][y])
            for i in np.flatnonzero(sizes > 256):
                group = order[cuts[i] : cuts[i + 1]]
                x, y = link_bucket(fps[group], distance, (low + half if part == low else low, half))
                a.append(group[x])
                b.append(group[y])
        if sum(map(len, a)) > 4_000_000:  # keep a spanning forest only
            root = _roots(len(fps), np.concatenate(a), np.concatenate(b))
            a, b = [np.arange(len(fps))], [root]
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(distance: int):
    """mapInArrow over (key, fp) sorted by both: star edges of each bucket's verified components."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(cuts)
        small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
        where = np.flatnonzero(small)
        x, y = _pairs(fps[where], keys[where], distance, 64)
        a, b = [where[x]], [where[y]]
        for i in np.flatnonzero(sizes > 64):
            start, key = cuts[i], int(keys[cuts[i]])
            if key >> 62 & 1:  # level 2: the half that was cut, then the quarter that was cut
                half, quarter = key >> 58 & 1, key >> 20 & 1
                free = ((0 if half else 32) + (0 if quarter else 16), 16)
            else:
                free = ((0 if key >> 37 & 1 else 32), 32)
            x, y = link_bucket(fps[start : cuts[i + 1]], distance, free)
            a.append(start + x)
            b.append(start + y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            ends, where = np.unique(np.concatenate((fps[a], fps[b])), return_inverse=True)
            root = _roots(len(ends), where[: len(a)], where[len(a) :])
            a, b = ends, ends[root]
            a, b = a[a != b], b[a != b]
        else:
            a = b = np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = [], []  # the rows of the last bucket so far: bounded by the bucket's own bound
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            first = int(np.searchsorted(k, k[-1]))
            if first or (held_k and held_k[0][0] != k[0]):
                yield links(np.concatenate([*held_k, k[:first]]), np.concatenate([*held_f, f[:first]]))
                held_k, held_f = [k[first:]], [f[first:]]
            else:
                held_k.append(k)
                held_f.append(f)
        if held_k:
            yield links(np.concatenate(held_k), np.concatenate(held_f))

    return run


def _bits(column: Column, low: int | Column, width: int) -> Column:
    shift = F.lit(low) if isinstance(low, int) else low
    return F.call_function("shiftrightunsigned", column, shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def _without(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))


def _left(value: Column, by: int) -> Column:
    return F.shiftleft(value.cast("long"), by)


def linked(distinct: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Components among ``distinct`` fingerprints (fp long, unique) that link at ``distance`` (0 to 3) or fewer bits.

    Returns (node, root) for fingerprints with a link. A 64-bit fingerprint is cut into two halves: of two that differ
    by three bits at most, one half differs by one at most, so they share that half with one bit left out. Each
    fingerprint gives 2 x 32 such keys; equal keys meet and their fingerprints are compared. A key's bucket is the union
    of two values of a half, so counting halves tells beforehand which buckets are too large; those are cut again by the
    same rule on the other half's quarters (2 x 16 keys).
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find 3 differing bits at most")
    j = F.col("j")
    half = _bits(F.col("fp"), (j >= 32).cast("int") * 32, 32)
    key = _left(j, 32).bitwiseOR(_without(half, j % 32))
    keys = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select(key.alias("key"), "fp")
    halves = distinct.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("h"), "fp").select("h", _bits(F.col("fp"), F.col("h") * 32, 32).alias("value"))
    heavy = halves.groupBy("h", "value").count().where(F.col("count") > bucket // 2)
    if not heavy.isEmpty():
        j = F.col("h") * 32 + F.col("b")
        cut = heavy.select("h", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("b")).select(_left(j, 32).bitwiseOR(_without(F.col("value"), F.col("b"))).alias("key")).distinct()
        cut = written(cut.withColumn("deep", F.lit(True)), "heavy")
        marked = join_on_hot_key(keys, cut, "key", "left")
        q, b = F.floor(F.col("k") / 16).cast("int"), F.col("k") % 16
        other = F.when(F.col("key").bitwiseAND(F.lit(1 << 37)) != 0, 0).otherwise(32)
        part = _bits(F.col("fp"), other + q * 16, 16)
        deep = F.lit(1 << 62).bitwiseOR(_left(F.col("key"), 21)).bitwiseOR(_left(q, 20)).bitwiseOR(_left(b, 16)).bitwiseOR(_without(part, b))
        keys = marked.where("deep IS NULL").select("key", "fp").unionAll(marked.where("deep").select("key", "fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")).select(deep.alias("key"), "fp"))
    edges = keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links(distance), "u long, v long")
    return components(edges)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id linked).

    A text without words (null, empty, blanks) has fingerprint 0 and links like any other. A row with a null id takes
    part; a component of null ids only has a null component_id. Repeated rows each get their row. Other columns of the
    input are not used. An empty table gives an empty result.
    """
    prints = written(fingerprints(df, id_col, text_col, size), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = linked(distinct.select("fp"), distance)
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(join_on_hot_key(of.select("fp", "root"), least, "root").select("fp", "component_id"), "named")
    return join_on_hot_key(prints, named, "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
