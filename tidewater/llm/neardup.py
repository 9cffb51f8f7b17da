"""Near-duplicates by SimHash at a likeness of word shingles: candidates by one-wildcard segments, then verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import components, discard, if_small, join_on_hot_key, sliced, written
from .simhash import majority_bits, shingle_hashes

#: Four fingerprints of 64 bits, of which three segments of 18 bits each are indexed: at a likeness of 0.8 some 15 % of the
#: bits differ, so one segment differs by one bit at most in 22 % of cases, one of twelve in 95 %; more above 0.8.
FINGERPRINTS, SEGMENTS, WIDTH = 4, 12, 18
#: A segment has three parts. Texts that differ in one bit of it agree in two parts, so rows meet by each two parts (3 rows
#: a segment instead of 18), and the six wildcards of the third are tried inside the task.
PART = WIDTH // 3
#: Bits of 256 that a candidate may differ by: 2.7 standard deviations over what a likeness of 0.8 gives.
FAR = 54
BINS = 256
#: Least shingle hashes kept of a text for the second round: all of them in a text of so many at most.
LEAST = 256
#: Standard errors below the threshold at which a sketch rules a pair out.
ERRORS = 3.0
#: Rows of a run (equal up to its wildcard) whose pairs are all tested at once; larger runs are linked by stars first.
RUN = 64
_U = np.uint64
_NODE = "key int, node long, f0 long, f1 long, f2 long, f3 long, size int"


def sketch(hashes: np.ndarray) -> bytes:
    """A byte (1 to 255) of the least hash in each of 256 bins, 0 for an empty bin; of ascending hashes."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        where, first = np.unique(hashes >> _U(56), return_index=True)
        out[where.astype(np.int64)] = hashes[first] % _U(255) + _U(1)
    return out.tobytes()


def fingerprints(hashes: np.ndarray) -> list[int]:
    """Four SimHashes of a set of shingle hashes, each over another mix of them."""
    out = []
    for k in range(FINGERPRINTS):
        x = hashes * _U(0x9E3779B97F4A7C15 + 2 * k * 0x1234567) ^ (hashes >> _U(29))
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        out.append(majority_bits(x ^ (x >> _U(29))))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard likeness of two sets of distinct shingle hashes; 1 if both are empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def likely(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sketches (rows, bins) don't rule the threshold out, by ``ERRORS`` standard errors."""
    either = ((a | b) != 0).sum(1)
    equal = ((a == b) & (a != 0)).sum(1)
    margin = ERRORS * np.sqrt(threshold * (1 - threshold) / np.maximum(either, 1))
    return equal >= (threshold - margin) * either


def least(hashes: np.ndarray) -> bytes:
    """The ``LEAST`` smallest of a set's hashes by their upper halves, ascending, filled up with the largest number."""
    out = np.full(LEAST, 0xFFFFFFFF, np.uint32)
    some = np.unique(hashes >> _U(32)).astype(np.uint32)[:LEAST]
    out[: len(some)] = some
    return out.tobytes()


def nearly(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the least hashes (rows, LEAST) don't rule the threshold out: exactly if both rows hold whole sets, else by ``ERRORS`` standard errors."""
    both = np.sort(np.concatenate((a, b), 1), 1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0xFFFFFFFF)
    some = np.concatenate((np.ones((len(a), 1), bool), both[:, 1:] != both[:, :-1]), 1) & (both != 0xFFFFFFFF)
    whole = (a[:, -1] == 0xFFFFFFFF) & (b[:, -1] == 0xFFFFFFFF)
    seen = some.cumsum(1) <= np.where(whole, 2 * LEAST, LEAST)[:, None]
    equal, either = (twice & seen[:, 1:]).sum(1), (some & seen).sum(1)
    margin = np.where(whole, 0.01, ERRORS * np.sqrt(threshold * (1 - threshold) / LEAST))
    return equal >= (threshold - margin) * either


def _described(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """Every row of ``df`` (as the struct r) with a number, and what is compared: class, fingerprints, size, sketch, least hashes."""
    names = ["c0", "c1", "f0", "f1", "f2", "f3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            known: dict[str | None, tuple] = {}
            texts = batch.column(0).field(text_col).cast(pa.string()).to_pylist()
            for t in texts:
                if t not in known:
                    hashes = np.unique(shingle_hashes(t, size))
                    same = xxhash.xxh3_128_intdigest(hashes.tobytes())
                    known[t] = ([same & (1 << 64) - 1, same >> 64, *fingerprints(hashes)], len(hashes), sketch(hashes), least(hashes))
            longs = np.array([known[t][0] for t in texts], np.uint64).reshape(-1, len(names)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(c)) for c in longs.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([known[t][1] for t in texts], pa.int32()), *(pa.array([known[t][k] for t in texts], pa.binary()) for k in (2, 3))], names=["r", *names, "size", "sketch", "least"])

    given = df.select(F.struct("*").alias("r"))
    schema = f"r {given.schema['r'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", size int, sketch binary, least binary"
    return given.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())  # fixed once written


def _keyed(nodes: DataFrame, *more: str) -> DataFrame:
    """A row of each node for every segment and each two of its three parts, key: those twelve bits, numbered."""
    j, every = F.col("j"), (1 << PART) - 1
    seg, q = F.floor(j / 3).cast("int"), j % 3
    fp = F.element_at(F.array("f0", "f1", "f2", "f3"), (F.floor(seg / 3) + 1).cast("int"))
    value = F.call_function("shiftrightunsigned", fp, (seg % 3) * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")

    def bits(of: Column, at: int, n: int) -> Column:
        return F.call_function("shiftright", of, F.lit(at)).bitwiseAND(F.lit((1 << n) - 1))

    two = F.when(q == 0, bits(value, PART, 2 * PART)).when(q == 1, F.call_function("shiftleft", bits(value, 2 * PART, PART), F.lit(PART)).bitwiseOR(value.bitwiseAND(F.lit(every)))).otherwise(bits(value, 0, 2 * PART))
    key = F.call_function("shiftleft", j, F.lit(2 * PART)).bitwiseOR(two)
    dealt = nodes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3 * SEGMENTS - 1)))).select(key.alias("key"), "node", "f0", "f1", "f2", "f3", "size", *more)
    return dealt.repartition("key").sortWithinPartitions("key", "node")


class _Rows:
    """Rows of whole groups, sorted by key and node, and the test of pairs of them."""

    def __init__(self, columns: list, threshold: float):
        self.key, self.node, self.size, self.more, self.threshold = columns[0], columns[1], columns[6], columns[7:], threshold
        self.f = np.stack([c.view(np.uint64) for c in columns[2:6]], 1)
        self.segment = self.key >> (2 * PART)  # three numbers a segment
        self.q = self.segment % 3
        self.segment //= 3
        shift = (self.segment % 3 * WIDTH).astype(np.uint64)
        self.value = ((self.f[np.arange(len(self.key)), self.segment // 3] >> shift) & _U((1 << WIDTH) - 1)).astype(np.int64)

    def meets(self, i: np.ndarray, j: np.ndarray, b: int) -> np.ndarray:
        """Which pairs of one run may be alike and are this run's own: the first segment and wildcard that they share."""
        x = self.f[i] ^ self.f[j]
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        ok = (np.bitwise_count(x).sum(1, dtype=np.int64) <= FAR) & (small >= self.threshold * large)
        at = np.flatnonzero(ok)
        i, j, x = i[at], j[at], x[at]
        apart, q = self.value[i] ^ self.value[j], self.q[i]
        own = (apart == 1 << (PART * q + b)) | ((apart == 0) & (q == 2) & (b == 0))
        for s in range(SEGMENTS - 1):
            bits = np.bitwise_count((x[:, s // 3] >> _U(s % 3 * WIDTH)) & _U((1 << WIDTH) - 1))
            own &= (bits > 1) | (self.segment[i] <= s)
        ok[at[~own]] = False
        return ok

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(wildcard, rows in order, where each run starts, with the end)."""
        part = (self.value >> (PART * self.q)) & ((1 << PART) - 1)
        for b in range(PART):
            alike = (self.key.astype(np.int64) << PART) | (part & ~(1 << b))
            order = np.argsort(alike, kind="stable")
            alike = alike[order]
            yield b, order, np.flatnonzero(np.concatenate(([True], alike[1:] != alike[:-1], [True])))


def _steps(order: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (earlier, later) inside the runs of 2 to RUN rows, by their distance in the order."""
    sizes = np.diff(cuts)
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= RUN), sizes))
    ends = np.repeat(cuts[1:], sizes)
    for step in range(1, RUN):
        rows = rows[rows + step < ends[rows]]
        if not len(rows):
            return
        yield order[rows], order[rows + step]


def _crossed(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one of ``a`` and one of ``b``, in parts of bounded size."""
    step = max(1, 200_000 // max(len(b), 1))
    for at in range(0, len(a) if len(b) else 0, step):
        part = a[at : at + step]
        yield np.repeat(part, len(b)), np.tile(b, len(part))


def _first_round(rows: _Rows) -> pa.RecordBatch:
    """A pair for each row and group with the smallest node that it meets, and whether either meets others too."""
    us, vs, flags = [], [], []

    def kept(i: np.ndarray, j: np.ndarray) -> None:
        us.append(j)
        vs.append(i)
        flags.append(np.zeros(len(i), bool))

    for b, order, cuts in rows.runs():
        for i, j in _steps(order, cuts):
            ok = rows.meets(i, j, b)
            kept(i[ok], j[ok])
        for r in np.flatnonzero(np.diff(cuts) > RUN):
            run = order[cuts[r] : cuts[r + 1]]
            star, left, held = np.full(len(run), -1), np.arange(len(run)), []
            while len(left):  # the first one left is a centre: all that it meets join its star
                ok = rows.meets(np.full(len(left) - 1, run[left[0]]), run[left[1:]], b)
                mine = left[1:][ok]
                star[left[0]] = star[mine] = len(held)
                held.append(mine)
                us.append(run[mine])
                vs.append(np.full(len(mine), run[left[0]]))
                flags.append(np.full(len(mine), len(mine) > 1))  # pairs inside a star aren't tested yet
                left = left[1:][~ok]
            for s, mine in enumerate(held):  # centres have met all; other members still have to meet those of later stars
                for i, j in _crossed(mine, np.flatnonzero(star > s)):
                    i, j = run[np.minimum(i, j)], run[np.maximum(i, j)]
                    ok = rows.meets(i, j, b)
                    kept(i[ok], j[ok])
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs))
    more = np.concatenate([np.empty(0, bool), *flags])
    # of each row's pairs the one with the smallest node is emitted; rows of a pair that isn't need the second round
    order = np.lexsort((rows.node[v], u))
    u, v, more = u[order], v[order], more[order]
    first = np.concatenate(([True], u[1:] != u[:-1])) if len(u) else np.empty(0, bool)
    again = np.zeros(len(rows.node), bool)
    again[u[more]] = again[v[more]] = again[u[~first]] = again[v[~first]] = True
    known = np.zeros(len(rows.node), bool)
    known[u[first]] = known[v[first]] = True
    lost = ~first & ~known[v]  # a row that no emitted pair names
    _, at = np.unique(v[lost], return_index=True)
    emit = np.flatnonzero(first)
    emit = np.concatenate((emit, np.flatnonzero(lost)[at]))
    u, v = u[emit], v[emit]
    return pa.RecordBatch.from_arrays([pa.array(rows.node[u]), pa.array(rows.node[v]), pa.array(again[u]), pa.array(again[v])], names=["u", "v", "more_u", "more_v"])


def _second_round(rows: _Rows) -> pa.RecordBatch:
    """All pairs of different components that meet and whose least hashes don't rule them out."""
    comp, least_of = rows.more
    us, vs = [], []

    def test(i: np.ndarray, j: np.ndarray, b: int) -> None:
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]
        ok = rows.meets(i, j, b)
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 4096):
            part = slice(at, at + 4096)
            fine = nearly(least_of[i[part]], least_of[j[part]], rows.threshold)
            us.append(j[part][fine])
            vs.append(i[part][fine])

    for b, order, cuts in rows.runs():
        for i, j in _steps(order, cuts):
            test(i, j, b)
        for r in np.flatnonzero(np.diff(cuts) > RUN):
            run = order[cuts[r] : cuts[r + 1]]
            kinds, which, sizes = np.unique(comp[run], return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                continue
            for k in np.argsort(sizes, kind="stable")[:-1]:  # each component against larger ones, the largest against none
                mine, which[which == k] = np.flatnonzero(which == k), -1
                for i, j in _crossed(mine, np.flatnonzero(which >= 0)):
                    test(run[np.minimum(i, j)], run[np.maximum(i, j)], b)
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(rows.node[u]), pa.array(rows.node[v])], names=["u", "v"])


def _by_groups(done: Callable[[_Rows], pa.RecordBatch], threshold: float) -> Callable:
    """mapInArrow over rows sorted by key: ``done`` of the rows of whole groups."""

    def held(batch: pa.RecordBatch) -> list[np.ndarray]:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:8]]
        if batch.num_columns > 8:
            columns.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint32).reshape(-1, LEAST))
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = held(batch)
            first = int(np.searchsorted(now[0], now[0][-1]))  # the last group may go on in the next batch
            if first or (waiting and waiting[0][0][0] != now[0][0]):
                parts = [*waiting, [c[:first] for c in now]]
                yield done(_Rows([np.concatenate(c) for c in zip(*parts, strict=True)], threshold))
                waiting = [[c[first:] for c in now]]
            else:
                waiting.append(now)
        if waiting:
            yield done(_Rows([np.concatenate(c) for c in zip(*waiting, strict=True)], threshold))

    return run


def _sifted(threshold: float) -> Callable:
    """Over (u, v, a, b): the pairs whose sketches a and b don't rule the threshold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(likely(a, b, threshold)))

    return run


def _alike(threshold: float, size: int) -> Callable:
    """Over (u, v, a, b): the pairs whose texts a and b are alike by all their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep, known = [], {}
            for i in range(batch.num_rows):
                pair = [batch.column(k)[i].as_py() for k in (2, 3)]
                if len(known) > 64:  # bounded memory; rows of a text lie together
                    known = {t: known[t] for t in pair if t in known}
                for t in pair:
                    if t not in known:
                        known[t] = np.unique(shingle_hashes(t, size))
                keep.append(likeness(known[pair[0]], known[pair[1]]) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, of: DataFrame, key: str, value: str) -> DataFrame:
    """(u, v, a, b): each pair with ``value`` of both its ends."""
    met = join_on_hot_key(pairs, of.select(F.col(key).alias("u"), F.col(value).alias("a")), "u")
    return join_on_hot_key(met, of.select(F.col(key).alias("v"), F.col(value).alias("b")), "v").select("u", "v", "a", "b")


def _links(pairs: DataFrame, rows: DataFrame, text_col: str, threshold: float, size: int) -> DataFrame:
    """The ``pairs`` (u, v) whose texts are alike. Only texts that a pair names go on."""
    ends = written(pairs.select(F.col("u").alias("row")).unionAll(pairs.select(F.col("v").alias("row"))).distinct(), "ends")
    texts = rows.select("row", F.col(f"r.`{text_col}`").cast("string").alias("text")).join(if_small(ends), "row", "left_semi")
    return _with_both(pairs, texts, "row", "text").sortWithinPartitions("v").mapInArrow(_alike(threshold, size), "u long, v long")


def _grouped(df: DataFrame, id_col: str, text_col: str, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """The described rows, and for each class of equal shingle sets that isn't alone: c0, c1, the row and id that stay."""
    rows = written(_described(df, text_col, size), "described")
    c = F.col
    of = rows.where("size > 0").select("c0", "c1", "row", c(f"r.`{id_col}`").cast("long").alias("id"), "f0", "f1", "f2", "f3", "size", "sketch")
    first = F.min(F.struct(c("id").isNull().alias("none"), "id", "row")).alias("first")  # ids ascending, nulls last
    same = [F.min(x).alias(x) for x in ("f0", "f1", "f2", "f3", "size", "sketch")]
    nodes = written(of.groupBy("c0", "c1").agg(first, F.count("*").alias("n"), *same).withColumn("node", c("first.row")), "nodes")

    met = written(_keyed(nodes).mapInArrow(_by_groups(_first_round, threshold), "u long, v long, more_u boolean, more_v boolean"), "met")
    pairs = met.select("u", "v").distinct()
    near = written(_with_both(pairs, nodes, "node", "sketch").mapInArrow(_sifted(threshold), "u long, v long"), "near")
    roots = written(components(_links(near, rows, text_col, threshold, size)), "roots")
    # what met more than it was compared with is compared again, now only across components, and with its least hashes at hand
    more = met.select(F.explode(F.array(F.when(c("more_u"), c("u")), F.when(c("more_v"), c("v")))).alias("node")).where("node IS NOT NULL").distinct()
    more = written(more, "more")
    hashes = rows.select(c("row").alias("node"), "least").join(if_small(more), "node", "left_semi")
    open_ = nodes.drop("sketch").join(hashes, "node").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    rest = _keyed(open_, "comp", "least").mapInArrow(_by_groups(_second_round, threshold), "u long, v long")
    rest = written(rest, "rest")
    left = written(_links(rest, rows, text_col, threshold, size), "left")
    known = roots.withColumnRenamed("node", "u").withColumnRenamed("root", "to")
    joint = left.join(known, "u", "left").select(F.coalesce("to", "u").alias("u"), F.col("v").alias("w"))
    joint = joint.join(roots.withColumnRenamed("node", "w").withColumnRenamed("root", "to"), "w", "left").select("u", F.coalesce("to", "w").alias("v"))
    joined = components(joint).select(c("node").alias("comp"), c("root").alias("last"))

    named = nodes.select("c0", "c1", "n", "first", "node").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    named = written(named.join(joined, "comp", "left").select("c0", "c1", "n", "first", F.coalesce("last", "comp").alias("group")), "named")
    whole = named.groupBy("group").agg(F.min("first").alias("stays"), F.sum("n").alias("rows")).where("rows > 1")
    out = written(join_on_hot_key(named.select("c0", "c1", "group"), whole, "group").select("c0", "c1", c("stays.row").alias("kept_row"), c("stays.id").alias("kept_id")), "classes")
    for table in (nodes, met, near, roots, more, rest, left, named):
        discard(table)
    return rows, out


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, group): a row for each row of ``df`` that is a copy or near copy of another, and the smallest id of its group.

    Texts link at a Jaccard likeness of ``size``-word shingle sets of ``threshold`` or more, decided on all shingles of both.
    Candidates share one of twelve segments of their SimHashes up to one bit. A first round compares each with the smallest
    it meets and joins what links; a second one compares every pair across components that is left, so large groups of
    near copies cost a pair a member, and no candidate is dropped. Sketches of 256 hashes rule out pairs three standard errors
    under the threshold.

    Rows without words (null, empty, blank texts) are in no group. A row with a null id takes part; a group of such only
    has a null group. Repeated rows each get a row. Other columns are not used; an empty table gives an empty result. A text
    is held in memory whole, with 8 bytes a word.
    """
    rows, classes = _grouped(df, id_col, text_col, threshold, size)
    met = rows.select("c0", "c1", F.col(f"r.`{id_col}`").cast("long").alias("doc_id")).join(classes, ["c0", "c1"])
    return met.select("doc_id", F.col("kept_id").alias("group"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``df`` less those of a group but one: the row of the smallest id stays (nulls last, of equal ones any).

    See ``groups`` for the groups and for odd rows; rows without words all stay.
    """
    rows, classes = _grouped(df, id_col, text_col, threshold, size)
    gone = written(rows.select("c0", "c1", "row").join(classes, ["c0", "c1"]).where("row <> kept_row").select("row"), "gone")
    return rows.select("row", "r").join(if_small(gone), "row", "left_anti").select("r.*")
