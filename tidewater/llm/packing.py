"""Bounded-space online packing of token sequences into windows of a fixed length."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written

END = 1
SPECIAL = "<|endoftext|>"
#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A text's ids by the ``tokenizers`` file at ``path``, without special tokens added.

    A byte-level BPE whose ids are its merge ranks is run by tiktoken, which gives the same ids about seven times faster
    (tests hold the two against each other); any other file, and any text that tiktoken can't split, by tokenizers.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    by_hand = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, vocab = spec["model"], spec["model"].get("vocab", {})
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    split = spec.get("pre_tokenizer") or {}
    ranked = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and spec.get("normalizer") is None
    ranked = ranked and split.get("add_prefix_space") is False and split.get("use_regex", True)
    ranked = ranked and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not ranked or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or set(added) - {SPECIAL}:
        return by_hand
    import tiktoken

    of = _letters()
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in added}
    fast = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except BaseException as error:  # the Rust part panics on some extreme texts
            if type(error).__name__ != "PanicException":
                raise
            return by_hand(text)

    return ids


class Packer:
    """Open windows, at most ``windows`` of them, of ``length`` tokens each. ``put`` places a piece best-fit; where none
    fits, the fullest is emitted: filled with the piece's first tokens if over ``gap`` places are free, else as it is."""

    def __init__(self, length: int, windows: int, gap: int):
        self.length, self.windows, self.gap = length, windows, gap
        self.open: list[tuple[int, int]] = []  # (free places, window), ascending
        self.held: dict[int, list] = {}
        self.made = 0
        self.done: list[list] = []

    def put(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.length:
                self.done.append([(doc, start, ids[: self.length], total)])
                start, ids = start + self.length, ids[self.length :]
                continue
            at = bisect.bisect_left(self.open, (len(ids), -1))
            if at < len(self.open):
                free, window = self.open.pop(at)
                self._place(window, free, (doc, start, ids, total))
                return
            if len(self.open) < self.windows:
                self.made += 1
                self._place(self.made, self.length, (doc, start, ids, total))
                return
            free, window = self.open.pop(0)
            if free > self.gap:
                self._place(window, free, (doc, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            else:
                self.done.append(self.held.pop(window))

    def _place(self, window: int, free: int, piece: tuple) -> None:
        self.held.setdefault(window, []).append(piece)
        free -= len(piece[2])
        if free:
            bisect.insort(self.open, (free, window))
        else:
            self.done.append(self.held.pop(window))

    def leftovers(self) -> list[list]:
        rest = [self.held.pop(w) for _, w in self.open]
        self.open.clear()
        return rest


def cut(pieces: list[tuple], length: int) -> list[list]:
    """The last leftovers end to end: full sequences, then one for each power of two in what remains, so none is padded."""
    sizes: list[int] = []
    left = sum(len(p[2]) for p in pieces)
    sizes += [length] * (left // length)
    left %= length
    sizes += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    made: list[list] = []
    room = 0
    for doc, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = sizes[len(made)]
                made.append([])
            take = min(room, len(ids))
            made[-1].append((doc, start, ids[:take], total))
            start, ids, room = start + take, ids[take:], room - take
    return made


def _rows(sequences: list[list], first: int, keep_ids: bool) -> pa.RecordBatch:
    """Finished sequences get their ids from ``first`` on; leftovers (keep_ids) carry their tokens and no crc."""
    out: list[list] = [[] for _ in range(8)]
    for n, pieces in enumerate(sequences):
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            for column, value in zip(out, (doc, start, len(ids), None if keep_ids else zlib.crc32(raw), total, None if keep_ids else first + n, offset, raw if keep_ids else None), strict=True):
                column.append(value)
            offset += len(ids)
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(out, names, strict=True)], names=names)


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, windows: int = 64, gap: int = 16, fan_in: int = 16, end: int = END) -> DataFrame:
    """Pack every text's ids and the id ``end`` into sequences of at most ``length`` tokens; a row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each partition packs online with a fixed
    number of open windows. What stays open at its end (``windows`` windows at most) is written and merged the same way,
    ``fan_in`` partitions at a time, until one task holds the rest; that is cut into full sequences and, at the end,
    sequences of a power of two. Padding: ``gap`` places at most in a sequence that no piece fitted.

    A null or empty text is the id ``end`` alone. Repeated rows are packed each for itself; null ids are kept; other
    columns, whatever their names, are not used; an empty table gives an empty result. A text and its ids are held whole, one
    text at a time; beside them ``windows`` open windows. Pieces of a lost task are made again alike: tasks are
    the input's partitions, and each round is written before the next reads it.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, n = encoder(tokenizer), Packer(length, windows, gap), TaskContext.get().partitionId() << 32
        tail = np.array([end], np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.concatenate((ids(text), tail)) if text else tail
                packer.put(doc, 0, tokens, len(tokens))
                if len(packer.done) >= 512:
                    yield _rows(packer.done, n, False)
                    n += len(packer.done)
                    packer.done.clear()
        yield _rows(packer.done, n, False)
        yield _rows(packer.leftovers(), 0, True)

    def merge(round_no: int, last: bool):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            packer, n = Packer(length, windows, gap), (round_no << 56) + (key[0].as_py() << 32)
            pieces = [(d, s, np.frombuffer(i, "<u4"), t) for d, s, i, t in zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
            pieces.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1], p[2].tobytes()))
            for piece in pieces:
                packer.put(*piece)
            rest = packer.leftovers()
            full = packer.done + (cut([p for w in rest for p in w], length) if last else [])
            made = pa.Table.from_batches([_rows(full, n, False), *([] if last else [_rows(rest, 0, True)])])
            return made.append_column("part", pa.array([key[0].as_py()] * len(made), pa.int32()))

        return run

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done, parts, round_no = [], max(1, docs.rdd.getNumPartitions()), 0
    table = written(docs.mapInArrow(first, PIECES).withColumn("part", F.spark_partition_id()), "pieces")
    while True:
        done.append(table.where("ids IS NULL"))
        round_no, parts = round_no + 1, -(-parts // fan_in)
        rest = table.where("ids IS NOT NULL").withColumn("group", F.floor(F.col("part") / fan_in).cast("int"))
        table = written(rest.groupBy("group").applyInArrow(merge(round_no, parts == 1), PIECES + ", part int"), "pieces")
        if parts == 1:
            done.append(table)
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.drop("ids", "part")
