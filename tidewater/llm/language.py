"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Documents that a language's model is counted over, about: all if there are fewer, else a share of them by hash.
SAMPLE = 1500
#: Nats that a change of language between two words costs.
SWITCH = 12.0
CHUNK = 400_000

#: Scripts by their letters' ranges of code points.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its script (0: another)."""
    letter = np.zeros(0x110000, bool)
    for at in range(0x110000):
        if at < 0x33000 or 0x0E0000 <= at < 0x0E0200:
            letter[at] = unicodedata.category(chr(at))[0] == "L"
    script = np.zeros(0x110000, np.uint8)
    for i, (_, ranges) in enumerate(SCRIPTS, 1):
        for a, b in ranges:
            script[a : b + 1] = i
    return letter, script


@dataclass
class Words:
    """A text's runs of letters: code point offsets, buckets of their trigrams (end to end), and scripts."""

    start: np.ndarray
    end: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # of each word in grams
    script: np.ndarray


def _codes(text: str) -> np.ndarray:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")


def split(codes: np.ndarray) -> Words:
    """Words of letters; each word of n letters has n + 1 trigrams, over its letters and a mark at either end."""
    letter, script = _tables()
    known = letter[codes]
    step = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    marked = np.concatenate(([1, 1], np.where(known, codes, 1), [1])).astype(np.uint32)
    at = np.concatenate((known, [False]))
    at[end] = True
    where = np.flatnonzero(at)  # letters, and the place after each word
    c0, c1, c2 = marked[where + 2], marked[where + 1], marked[where]
    c2 = np.where(c1 == 1, np.uint32(1), c2)
    mixed = c0 * np.uint32(0x9E3779B1) ^ c1 * np.uint32(0x85EBCA6B) ^ c2 * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    grams = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    lengths = end - start + 1
    return Words(start, end, grams, np.cumsum(lengths) - lengths, script[codes[start]] if len(start) else np.zeros(0, np.uint8))


def pieces(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """The whole text's code points in parts of bounded length, cut between words wherever there is one."""
    letter, _ = _tables()
    codes, at = _codes(text), 0
    while at < len(codes):
        stop = min(at + CHUNK, len(codes))
        if stop < len(codes):
            gaps = np.flatnonzero(~letter[codes[at:stop]])
            stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
        yield at, codes[at:stop]
        at = stop


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logs: np.ndarray  # (buckets, languages)
    scripts: np.ndarray  # (scripts, languages): whether the language is written in it

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages): log likelihoods; a language not written in a word's script is out of the running for it."""
        if not len(words.start):
            return np.zeros((0, len(self.langs)))
        out = np.add.reduceat(self.logs[words.grams], words.first, 0).astype(np.float64)
        fits = self.scripts[words.script]
        none = ~fits.any(1)
        out[none] = 0
        out[~(fits | none[:, None])] -= 200
        return out


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, where each change between neighbours costs ``switch``."""
    rows, n = scores.tolist(), scores.shape[1]
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(range(n), key=best.__getitem__)
        over = best[top] - switch
        back.append([k if best[k] >= over else top for k in range(n)])
        best = [s + (b if b >= over else over) for s, b in zip(row, best, strict=True)]
    path = [max(range(n), key=best.__getitem__)]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


def steady(scores: np.ndarray, first: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """For documents laid end to end (``first`` word of each): the language of the highest sum, and whether it is surely the
    best path throughout: no run of words gains over half of ``switch`` by another language, so a path of m such runs, which
    has m - 1 changes at least, doesn't pay for them."""
    totals = np.add.reduceat(scores, first, 0)
    best = totals.argmax(1)
    docs = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(scores))))
    gain = scores - scores[np.arange(len(scores)), best[docs]][:, None]
    sums = gain.cumsum(0)
    ahead = np.concatenate((np.zeros((1, scores.shape[1])), sums[:-1]))
    sums, ahead = sums - ahead[first][docs], ahead - ahead[first][docs]
    drop = docs[:, None] * (2 * np.abs(sums).max() + 1)  # lower from document to document, so that running minima start anew
    rise = sums - drop - np.minimum.accumulate(ahead - drop, 0)
    return best, (np.maximum.reduceat(rise, first, 0) <= switch / 2).all(1)


def label(model: Model, texts: list[str | None], switch: float = SWITCH) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text. Language: that of most letters. Score: its share of the letters, at most its
    posterior. Spans: (start, end, language) by code points. A text without letters: und, 0, no spans."""
    for text in texts:
        got, offsets = [], []
        for at, codes in pieces(text or "") if model.langs else ():
            words = split(codes)
            if len(words.start):
                got.append(model.scores(words))
                offsets.append(np.stack((words.start + at, words.end + at)))
        if not got:
            yield "und", 0.0, []
            continue
        scores, place = np.concatenate(got), np.concatenate(offsets, 1)
        best, sure = steady(scores, np.zeros(1, np.int64), switch)
        path = np.full(len(scores), best[0]) if sure[0] else viterbi(scores, switch)
        letters = np.bincount(path, place[1] - place[0], len(model.langs))
        lang, total = int(letters.argmax()), scores.sum(0)
        posterior = 1 / np.exp(np.clip(total - total[lang], -700, 700)).sum()
        cuts = np.flatnonzero(np.diff(path, prepend=-1))
        ends = np.append(cuts[1:], len(path)) - 1
        spans = [(int(place[0, a]), int(place[1, b]), model.langs[path[a]]) for a, b in zip(cuts, ends, strict=True)]
        yield model.langs[lang], float(min(letters[lang] / letters.sum(), posterior)), spans


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Count trigrams of ``rows`` (id long, text, lang) by language, over about ``sample`` documents of each.

    The share of a language's documents that count is by a hash of the id, fixed for given rows; each task sends one
    table of counts a language.
    """
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    limit = F.lit(0)
    for lang in langs:
        limit = F.when(F.col("lang") == lang, int(1e6 * min(1, sample / sizes[lang])) + 1).otherwise(limit)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000)) < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        letters = np.zeros((len(langs), len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = langs.index(lang)
                for _, codes in pieces(text):
                    words = split(codes)
                    counts[i] += np.bincount(words.grams, minlength=BUCKETS)
                    letters[i] += np.bincount(words.script, words.end - words.start, len(SCRIPTS) + 1).astype(np.int64)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary()), pa.array([letters.tobytes()], pa.binary())], names=["counts", "letters"])

    counts = np.zeros((len(langs), BUCKETS), np.int64)
    letters = np.zeros((len(langs), len(SCRIPTS) + 1), np.int64)
    for r in chosen.select("text", "lang").repartition(8).mapInArrow(run, "counts binary, letters binary").toLocalIterator():
        counts += np.frombuffer(r["counts"], np.int64).reshape(counts.shape)
        letters += np.frombuffer(r["letters"], np.int64).reshape(letters.shape)
    logs = np.log((counts + 0.2) / (counts.sum(1, keepdims=True) + 0.2 * BUCKETS)).T.astype(np.float32)
    return Model(langs, np.ascontiguousarray(logs), (letters >= 0.01 * np.maximum(letters.sum(1, keepdims=True), 1)).T)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans (start, end, lang), of every whole text; one row per input row.

    und with score 0 and no spans for a null text or one without a letter (or if no language was learned). Ties go to the
    language first in order. Null ids and repeated rows are kept; other columns, whatever their names, are not used; an empty
    table gives an empty result. A text is split in parts of 400,000 characters; held whole are its words' scores, 8 bytes a
    word and language.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(label(model, batch.column(1).to_pylist(), switch))
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                columns.append(pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in f[2]] for f in found], span))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", *["spans"] * spans])

    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans)
