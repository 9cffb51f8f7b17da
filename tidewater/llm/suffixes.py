"""Passages that repeat across documents, by sparse suffixes at minimiser positions and the windows they stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import discard, join_on_hot_key, written

#: A passage of MIN words holds MIN - GRAM + 1 runs of GRAM words. Each window of WINDOW runs keeps its least one, so the
#: kept position of a passage's first MIN words is at most WINDOW - 1 = MIN - SEED words from its start, with SEED words
#: to follow inside it.
MIN, GRAM, SEED = 50, 8, 27
WINDOW = MIN - SEED + 1
HOT = 1000  # suffixes of a seed that are grouped inside one task; those of more frequent seeds are aggregated by context and window
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


def _runs(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on."""
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total * _P + words[at + j]
    return _mixed(total)


def _stands(words: np.ndarray) -> np.ndarray:
    """For each run of MIN words the kept (minimiser) position inside it; never falling; none in a shorter text."""
    n = len(words) - MIN + 1
    if n < 1:
        return np.empty(0, np.int64)
    grams = _runs(words, np.arange(n + WINDOW - 1), GRAM)
    kept = []
    for part in range(0, n, 100_000):  # bounded memory for very long texts
        view = np.lib.stride_tricks.sliding_window_view(grams[part : min(part + 100_000, n) + WINDOW - 1], WINDOW)
        kept.append(view.argmin(1) + np.arange(part, part + len(view)))
    return np.concatenate(kept)


def positions(words: np.ndarray) -> np.ndarray:
    """The retained suffixes: kept positions, each with a whole seed to follow; none in a text shorter than a passage."""
    return np.unique(_stands(words))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, seeds, known = [], [], {}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text not in known:
                words = word_hashes(text)
                at = positions(words)
                known[text] = (at, _runs(words, at, SEED).view(np.int64))
            at, seed = known[text]
            ids.append(np.stack((np.full(len(at), doc, np.int64), at)))
            seeds.append(seed)
        both = np.concatenate(ids, 1) if ids else np.empty((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1].astype(np.int32)), pa.array(np.concatenate(seeds) if seeds else np.empty(0, np.int64))], names=["doc_id", "at", "seed"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each retained suffix with the start of the first run of MIN words that it stands for, and the hashes of all of them."""
    for batch in batches:
        for doc, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words, places = word_hashes(text), np.unique(np.array(places, np.int64))
            hot = places < 0
            places = np.where(hot, -1 - places, places)
            stands = _stands(words)
            first, stop = (np.searchsorted(stands, places, side) for side in ("left", "right"))
            held = stop > first
            if not held.any():
                continue
            places, hot, first, n = places[held], hot[held], first[held], (stop - first)[held]
            offsets = np.concatenate(([0], n.cumsum()))
            starts = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], n)
            hashes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_runs(words, starts, MIN).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_runs(words, places, SEED).view(np.int64)), pa.array(hot), pa.array(np.full(len(n), doc, np.int64)), pa.array(first.astype(np.int32)), hashes], names=["seed", "hot", "doc_id", "first", "hashes"])


SPANS = "doc_id long, start int, stop int, partner long"


def _shared(docs: np.ndarray, first: np.ndarray, n: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """(doc, start, stop, partner): windows of equal hash in two documents, each with the smallest other one, joined to runs."""
    row = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(row)) + np.repeat(first - (n.cumsum() - n), n)
    order = np.lexsort((docs[row], hashes))
    key, doc = hashes[order], docs[row[order]]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = new.cumsum() - 1
    least = doc[new][group]
    other = np.flatnonzero(doc != least)  # in order: the first of a group is of its second smallest document
    had, at = np.unique(group[other], return_index=True)
    second = np.full(group[-1] + 1 if len(group) else 0, -1)
    second[had] = other[at]
    ok = second[group] >= 0
    low = np.where(doc == least, doc[second[group]], least) if len(group) else least
    partner, whole = np.empty(len(row), np.int64), np.zeros(len(row), bool)
    partner[order], whole[order] = low, ok
    row, starts, partner = row[whole], starts[whole], partner[whole]
    cut = np.concatenate(([True], (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1) | (partner[1:] != partner[:-1]))) if len(row) else np.empty(0, bool)
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(row)) - 1 if len(row) else begin
    return [docs[row[begin]], starts[begin], starts[end] + MIN, partner[begin]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over suffixes sorted by seed: the runs of their windows that two documents hold."""

    def done(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        out = _shared(*(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4)))
        return pa.RecordBatch.from_arrays([pa.array(out[0]), *(pa.array(x.astype(np.int32)) for x in out[1:3]), pa.array(out[3])], names=[c.split()[0] for c in SPANS.split(", ")])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seed, doc, first = (c.to_numpy().astype(np.int64) for c in batch.columns[:3])
        n = batch.column(3).value_lengths().to_numpy().astype(np.int64)
        hashes = batch.column(3).flatten().to_numpy()
        at = int(np.searchsorted(seed, seed[-1]))  # the last seed may go on in the next batch
        cut = int(n[:at].sum())
        if at or (held and held[0][0][0] != seed[0]):
            yield done([*held, [seed[:at], doc[:at], first[:at], n[:at], hashes[:cut]]])
            held = [[seed[at:], doc[at:], first[at:], n[at:], hashes[cut:]]]
        else:
            held.append([seed, doc, first, n, hashes])
    if held:
        yield done(held)


def _of_hot(windows: DataFrame) -> DataFrame:
    """The same as ``_groups`` for seeds of any number of suffixes: by aggregates and joins on the hashes of windows.

    Suffixes of equal windows (copies of one context) make one class, known by a hash of them all, with its two smallest
    documents. A class's windows are listed once, however many copies it has, and its runs then go to each copy.
    """
    c = F.col
    hot = windows.select("doc_id", "first", F.xxhash64("hashes").alias("class"), "hashes")
    place = Window.partitionBy("class").orderBy("doc_id")
    ends = hot.select("class", "doc_id").distinct().withColumn("nth", F.row_number().over(place)).where("nth <= 2").groupBy("class").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    classes = written(hot.groupBy("class").agg(F.first("hashes").alias("hashes")).join(ends, "class"), "classes")
    each = classes.select("class", "low", "high", F.posexplode("hashes").alias("i", "hash"))
    least = each.groupBy("hash").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("hash", "least")
    met = written(join_on_hot_key(each, least, "hash"), "met")
    second = met.select("hash", F.when(c("low") != c("least"), c("low")).when(c("high") != c("least"), c("high")).alias("other")).groupBy("hash").agg(F.min("other").alias("second"))
    rest = met.where("low <> least").select("class", "i", "least", F.lit(None).cast("long").alias("second"))  # none of its documents is the least
    both = rest.unionAll(join_on_hot_key(met.where("low = least"), second, "hash").select("class", "i", "least", "second"))
    discard(classes)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for key, at in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for r in sorted(at, key=lambda r: r["i"]):
                    if out and out[-1][0] == key and out[-1][2] == r["i"] and out[-1][3:] == [r["least"], r["second"]]:
                        out[-1][2] += 1
                    else:
                        out.append([key, r["i"], r["i"] + 1, r["least"], r["second"]])
            kinds = {"class": pa.int64(), "begin": pa.int32(), "end": pa.int32(), "least": pa.int64(), "second": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    listed = both.groupBy("class").agg(F.collect_list(F.struct("i", "least", "second")).alias("at"))  # WINDOW at most
    spans = listed.mapInArrow(runs, "class long, begin int, end int, least long, second long")
    partner = F.when(c("doc_id") == c("least"), c("second")).otherwise(c("least"))
    return join_on_hot_key(hot.drop("hashes"), spans, "class").select("doc_id", (c("first") + c("begin")).alias("start"), (c("first") + c("end") - 1 + MIN).alias("stop"), partner.alias("partner"))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, partner): runs of words [start, stop) of a document that others hold too, all of whose runs of
    50 words are in ``partner``, the smallest id of another document for each.

    Every run of 50 words stands at a minimiser position inside it, chosen by its words alone, with 27 words (the seed) to
    follow inside it: equal runs have equal seeds. So all runs at positions whose seed is in two documents are compared, by
    hashes of 64 bits, and no other can be shared. Longer passages come as overlapping runs. Texts of fewer words, null ids
    and null texts have none; rows of one id are one document.
    """
    c = F.col
    docs = df.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = written(docs.mapInArrow(_anchors, "doc_id long, at int, seed long"), "anchors")
    shared = anchors.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a <> b").select("seed", (c("n") > HOT).alias("hot"))
    place = F.when(c("hot"), -1 - c("at")).otherwise(c("at"))
    kept = join_on_hot_key(anchors, shared, "seed").groupBy("doc_id").agg(F.collect_list(place).alias("places"))
    windows = written(docs.join(kept.hint("merge"), "doc_id").select("doc_id", "text", "places").mapInArrow(_windows, "seed long, hot boolean, doc_id long, first int, hashes array<long>"), "windows")
    discard(anchors)
    rest = windows.where("NOT hot").select("seed", "doc_id", "first", "hashes")
    found = written(rest.repartition("seed").sortWithinPartitions("seed").mapInArrow(_groups, SPANS).unionAll(_of_hot(windows.where("hot"))), "found")
    discard(windows)
    return found


def merge(runs: list[dict], first: str = "start", last: str = "stop") -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r[first], r[last]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with a repeated passage: doc_id, n_passages, repeated_words, passages, removable, partner.

    passages: merged runs as start:stop in words, comma-joined; removable: likewise those that a document of a smaller id
    holds too, so that cutting them leaves each passage in at least one document; partner: the smallest id it shares one
    with. An empty table gives an empty result. See ``repeats`` for nulls, short and repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
        for batch in batches:
            docs, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spans = [merge(x) for x in lists]
            later = [merge([r for r in x if r["partner"] < d]) for d, x in zip(docs, lists, strict=True)]
            columns = [pa.array([len(s) for s in spans], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([text(s) for s in spans], pa.string()), pa.array([text(s) for s in later], pa.string()), pa.array([min(r["partner"] for r in x) for x in lists], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_passages", "repeated_words", "passages", "removable", "partner"])

    each = repeats(df, id_col, text_col).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "partner")).alias("runs"))
    return each.mapInArrow(run, "doc_id long, n_passages long, repeated_words long, passages string, removable string, partner long")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the removable passages cut out of its texts, the remaining words joined by single spaces in texts that lose any.

    Texts that lose nothing, null and empty ones and rows of a null id stay as they are. Rows of one id are one document: its
    cuts, the union over its rows, apply to each of them. The result has the columns of ``df`` (which may have any names but
    _doc and _cut); an empty table gives an empty result. A text is held whole, as a list of its words.
    """
    cuts = repeated_passages(df, id_col, text_col).where("removable <> ''").select(F.col("doc_id").alias("_doc"), F.col("removable").alias("_cut"))
    at = F.transform(F.split("_cut", ","), lambda s: F.split(s, ":").cast("array<int>"))
    words = F.array_remove(F.split(F.col(text_col), "[ \t\n\x0b\f\r]+"), "")
    kept = F.filter(words, lambda _, i: ~F.exists(at, lambda s: (s[0] <= i) & (i < s[1])))
    met = df.join(cuts, F.col(id_col) == F.col("_doc"), "left")
    return met.withColumn(text_col, F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, " "))).select(*df.columns)
