"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end (exclusive), in code points

# -- fixed patterns ---------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"\[at\]|\(at\)", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern for addresses matches, in linear time: from each @ outwards, not from each possible start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four of each chain of dotted numbers, from its left, whose parts are 255 at most."""
    for chain in _CHAIN.finditer(text):
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start; a match that fails its test is dropped."""
    found: list[Span] = [(0, a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        found += [(1, a, b) for a, b in addresses(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


# -- the network ------------------------------------------------------------------------------------------------------

WINDOW, STRIDE, REACH = 96, 48, 40
TAGS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
_MARKS = "@.-+() \n:=\"'/_,%[]{}#*&$!?|;<>"
_OTHER, _LETTER, _PAD = 2, 3, 0


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """By code point: 0 padding, 1 digit, 2 other, 3 letter beyond ASCII, then marks, capitals (one code) and a-z."""
    table = np.full(0x110000, _LETTER, np.int16)
    table[:128] = _OTHER
    table[48:58] = 1
    for i, mark in enumerate(_MARKS):
        table[ord(mark)] = 4 + i
    table[65:91] = 4 + len(_MARKS)
    for c in range(97, 123):
        table[c] = 5 + len(_MARKS) + c - 97
    return table


CODES = 5 + len(_MARKS) + 26


def encode(text: str) -> np.ndarray:
    return _codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Embedding, an LSTM each way, a linear layer to tags, CRF transitions; float32 numpy throughout."""

    def __init__(self, seed: int = 5, width: int = 12, hidden: int = 20):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[-1])).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": draw(CODES, width), "out": draw(TAGS, 2 * hidden), "out_b": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for way in "fb":
            self.p[f"x{way}"], self.p[f"h{way}"] = draw(4 * hidden, width), draw(4 * hidden, hidden)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p[f"b{way}"] = bias

    def _run(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (time, rows, width). Hidden states by time, and what the way back needs."""
        n, h, p = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32), self.p
        c, out, kept = np.zeros_like(h), np.empty((*x.shape[:2], self.hidden), np.float32), []
        given = x @ p[f"x{way}"].T + p[f"b{way}"]
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + h @ p[f"h{way}"].T
            gate = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gate[:, :n], gate[:, n : 2 * n], gate[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, held = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep:
                kept.append((t, i, f, o, g, before, held, s))
        return out, kept

    def emissions(self, codes: np.ndarray, keep: bool = False):
        """codes: (rows, time). Tag scores (time, rows, tags)."""
        x = self.p["emb"][codes.T]
        (a, ka), (b, kb) = self._run(x, "f", keep), self._run(x, "b", keep)
        states = np.concatenate((a, b), 2)
        return states @ self.p["out"].T + self.p["out_b"], (x, states, ka, kb)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tags of each row (rows, time)."""
        e, move = self.emissions(codes)[0], self.p["move"]
        best, back = e[0] + self.p["first"], []
        for t in range(1, len(e)):
            over = best[:, :, None] + move
            back.append(over.argmax(1).astype(np.int8))
            best = over.max(1) + e[t]
        tags, rows = np.empty((len(codes), len(e)), np.int8), np.arange(len(codes))
        tags[:, -1] = best.argmax(1)
        for t in range(len(e) - 2, -1, -1):
            tags[:, t] = back[t][rows, tags[:, t + 1]]
        return tags

    def _back(self, way: str, x: np.ndarray, kept: list, up: np.ndarray, grads: dict) -> np.ndarray:
        n, p = self.hidden, self.p
        dz = np.empty((*x.shape[:2], 4 * n), np.float32)
        held_all = np.empty((*x.shape[:2], n), np.float32)
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        for t, i, f, o, g, before, held, s in reversed(kept):
            d = up[t] + dh
            dc = dc + d * o * (1 - s * s)
            dz[t] = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), d * s * o * (1 - o), dc * i * (1 - g * g)), 1)
            held_all[t] = held
            dh, dc = dz[t] @ p[f"h{way}"], dc * f
        flat = dz.reshape(-1, 4 * n)
        grads[f"x{way}"] = flat.T @ x.reshape(-1, x.shape[2])
        grads[f"h{way}"] = flat.T @ held_all.reshape(-1, n)
        grads[f"b{way}"] = flat.sum(0)
        return dz @ p[f"x{way}"]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag paths, and its gradients, by forward-backward."""
        e, (x, states, ka, kb) = self.emissions(codes, True)
        e, move, first = e.astype(np.float64), self.p["move"].astype(np.float64), self.p["first"].astype(np.float64)
        steps, rows, gold = len(e), np.arange(len(codes)), tags.T
        top = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + first
        for t in range(1, steps):
            alpha[t] = top(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = top(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = top(alpha[-1], 1)
        de = np.exp(alpha + beta - whole[:, None])
        d_first = de[0].sum(0)
        pairs = np.exp(alpha[:-1, :, :, None] + move + (e[1:] + beta[1:])[:, :, None, :] - whole[:, None, None]).sum((0, 1))
        gold_score = first[gold[0]] + np.take_along_axis(e, gold[:, :, None], 2).sum((0, 2)) + move[gold[:-1], gold[1:]].sum(0)
        np.subtract.at(de, (np.arange(steps)[:, None], rows[None, :], gold), 1)
        np.subtract.at(d_first, gold[0], 1)
        np.subtract.at(pairs, (gold[:-1], gold[1:]), 1)
        n = len(codes)
        de = (de / n).astype(np.float32)
        grads = {"move": (pairs / n).astype(np.float32), "first": (d_first / n).astype(np.float32), "out_b": de.sum((0, 1)), "out": np.tensordot(de, states, ((0, 1), (0, 1)))}
        up = de @ self.p["out"]
        dx = self._back("f", x, ka, up[:, :, : self.hidden], grads) + self._back("b", x, kb, up[:, :, self.hidden :], grads)
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], codes.T, dx)
        return float((whole - gold_score).mean()), grads


# -- labelled spans ---------------------------------------------------------------------------------------------------

_SYLLABLES = "the re an on er in at th ed sh le en que de la ión ado ment eau oi é ch sch ein ung ü ß der und es ta mo ri ku"


def labelled(count: int, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Invented lines with marked personal data in many forms, and with numbers and codes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    syllables = _SYLLABLES.split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    host = lambda: f"{word().encode('ascii', 'ignore').decode() or 'mail'}{pick(['', num(1)])}"

    def email() -> str:
        user = f"{host()}{pick(['', '.' + host(), '_' + host(), num(2), '.' + num(2), '+' + host()])}"
        at = pick(["@"] * 6 + [" (at) ", "(at)", " [at] ", "[at]", " @ "])
        return f"{user}{at}{pick(['', host() + '.'])}{host()}.{pick(['com', 'org', 'net', 'de', 'fr', 'example.com'])}"

    def ip() -> str:
        if rng.random() < 0.15:
            return ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8))
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))

    def card() -> str:
        digits = str(rng.integers(3, 7)) + num(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        gap = pick(["", " ", "-", ".", "  "])
        return gap.join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, a, b = num(3), num(3), num(4)
        return pick([f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+49 {num(3)} {num(7)}", f"+33 {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{num(2)} {num(3)} {num(6)}", f"({area}) {a} {b}", f"+{num(11)}", f"{area}.{a}.{b}"])

    def nothing() -> str:
        hexes = "".join(pick("0123456789abcdef") for _ in range(rng.integers(16, 44)))
        code = "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        year, small = f"{rng.integers(1900, 2100)}", str(rng.integers(0, 1000))
        return pick([f'token = "{hexes}"', f"AKIA{code}", f"password={hexes[:18]}", f"version {small}", f"{num(1)}.{num(1)}", f"v{num(1)}.{num(2)}.{num(1)}", year, f"{year}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{year}", f"{num(2)}:{num(2)}:{num(2)}", f"${small}.{num(2)}", f"{small},{num(3)}", f"No. {num(7)}", num(8), num(12), f"({small})", f"{small} of {small}", "CC BY-NC 4.0", f"@{host()}", f"#{small}", f"{small}%", f"{num(4)}-{num(4)}", f"{num(1)} {num(2)} {num(3)} {num(1)}", f"{small} | {num(2)} | {num(3)}", num(20), f"{num(2)}.{num(2)}.{year}", f"C{num(2)} @ {num(1)}"])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.integers(2, 6)):
            kind = rng.integers(0, 8)
            if kind < 4:
                thing = makers[kind]()
                spans.append((int(kind), len(text), len(text) + len(thing)))
                text += thing
            elif kind < 7:
                text += nothing()
            text += pick([" ", ", ", ". ", "\n", "; ", " "]) + " ".join(pick([word, lambda: word().capitalize(), lambda: word().upper()])() for _ in range(rng.integers(0, 5))) + pick([" ", ": ", " ", "\n"])
        cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        piece = text[cut : cut + WINDOW]
        out.append((piece, [(k, a - cut, b - cut) for k, a, b in spans if a >= cut and b <= cut + WINDOW]))
    # windows that cut through a span would teach half spans
    return [(t, s) for t, s in out if t]


@lru_cache(maxsize=1)
def trained(count: int = 1600, epochs: int = 14, batch: int = 80, rate: float = 0.012, seed: int = 5) -> Network:
    """Fit the network on labelled lines, by Adam; the same network for the same parameters."""
    net, rows = Network(seed), labelled(count)
    codes, tags = np.zeros((len(rows), WINDOW), np.int16), np.zeros((len(rows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(rows):
        codes[i, : len(text)] = encode(text)
        for kind, a, b in spans:
            tags[i, a:b] = 2 + 2 * kind
            tags[i, a] = 1 + 2 * kind
    rng, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for epoch in range(epochs):
        order, pace = rng.permutation(len(rows)), rate * (1 - epoch / epochs) + 0.001
        for i in range(0, len(rows), batch):
            _, grads = net.gradients(codes[order[i : i + batch]], tags[order[i : i + batch]])
            step += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                net.p[k] = (net.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# -- windows, reconciliation ------------------------------------------------------------------------------------------


def windows(text: str, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, from, to) of the windows that cover everything within reach of a digit, an @ or a written-out at, and of the
    words there: of a window's characters those between from and to count, nearer to its middle than to its neighbours'.

    Each kind of span holds one of these, so the rest of the text can't start or hold one; it is outside by rule.
    """
    near = np.flatnonzero((codes == 1) | (codes == 4))
    more = [m.start() for m in _LETTERS.finditer(text)] if "(" in text or "[" in text else []
    if more:
        near = np.sort(np.concatenate((near, np.array(more, np.int64))))
    if not len(near):
        return []
    cuts = np.flatnonzero(np.diff(near, prepend=-WINDOW - 2 * REACH) > 2 * REACH)
    out, done = [], 0
    for a, b in zip(near[cuts], near[np.append(cuts[1:], len(near)) - 1], strict=True):
        low, high = max(done, int(a) - REACH), min(len(codes), int(b) + REACH + 1)
        while low > done and not text[low - 1].isspace():  # the word that reach begins in counts whole
            low -= 1
        starts = range(low, max(low + 1, high - STRIDE), STRIDE)
        out += [(at, 0 if at == low else STRIDE // 2, WINDOW if at == starts[-1] else STRIDE + STRIDE // 2) for at in starts]
        done = high
    return out


def sound(kind: int, piece: str) -> bool:
    """Whether a span of the network can be of its kind at all."""
    digits = "".join(_DIGITS.findall(piece))
    if kind == 0:
        return ("@" in piece or bool(_LETTERS.search(piece))) and "." in piece
    if kind == 1:
        parts = re.split(r"[.:]", piece)
        if "." in piece:
            return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
        return len(parts) == 8 and all(re.fullmatch("[0-9A-Fa-f]{1,4}", p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", piece)
    return 9 <= len(digits) <= 15 and not re.search("[A-Za-z]", piece)


def reconcile(found: list[tuple[Span, int]], base: list[Span]) -> list[Span]:
    """One set of spans for the whole text out of all windows': base spans stay, nothing may overlap what is taken.

    A span weighs as many windows as agree on it, then its length; heavier ones are taken first, then the leftmost.
    """
    votes: dict[Span, int] = {}
    for span, _ in found:
        votes[span] = votes.get(span, 0) + 1
    starts, ends = [], []  # what is taken, apart and ascending
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added: list[Span] = []
    for span in sorted(votes, key=lambda s: (-votes[s], s[1] - s[2], s[1], s[0])):
        at = bisect.bisect_left(starts, span[2])  # those before it start before the span's end
        if not at or ends[at - 1] <= span[1]:
            starts.insert(at, span[1])
            ends.insert(at, span[2])
            added.append(span)
    return sorted([*base, *added])


def find_spans(texts: list[str], net: Network, rows: int = 4096) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each whole text. Windows of many texts are decoded together, ``rows`` at a time."""
    base = [base_spans(t) for t in texts]
    found: list[list[tuple[Span, int]]] = [[] for _ in texts]
    joint: dict[int, np.ndarray] = {}  # tags of whole texts, each character's from the window whose middle it is nearest to
    waiting: list[tuple[int, int, int, int, np.ndarray]] = []

    def spans_in(doc: int, row: np.ndarray, at: int, low: int, high: int) -> None:
        """Spans between low and high of a row of tags that begins at ``at``, but those that go on beyond them."""
        for a in np.flatnonzero(row[:high] % 2 == 1):
            kind, b = (int(row[a]) - 1) // 2, int(a) + 1
            while b < len(row) and row[b] == 2 + 2 * kind:
                b += 1
            if a >= low and b <= high and sound(kind, texts[doc][at + a : at + b]):
                found[doc].append(((kind, at + int(a), at + b), 1))

    def flush() -> None:
        codes = np.zeros((len(waiting), WINDOW), np.int16)
        for i, (*_, piece) in enumerate(waiting):
            codes[i, : len(piece)] = piece
        tags = net.decode(codes)
        for i in np.flatnonzero(tags.any(1)):
            doc, at, low, high, piece = waiting[i]
            text, row = texts[doc], tags[i, : len(piece)]
            joint.setdefault(doc, np.zeros(len(text), np.int8))[at + low : at + min(high, len(piece))] = row[low:high]
            first = 1 if at else 0
            last = len(piece) if at + len(piece) == len(text) else len(piece) - 1
            spans_in(doc, row, at, first, last)
        waiting.clear()

    for doc, text in enumerate(texts):
        if _DIGITS.search(text) or "@" in text or _LETTERS.search(text):
            codes = encode(text)
            for at, low, high in windows(text, codes):
                waiting.append((doc, at, low, high, codes[at : at + WINDOW]))
                if len(waiting) >= rows:
                    flush()
    if waiting:
        flush()
    for doc, tags in joint.items():
        spans_in(doc, tags, 0, 0, len(tags))
    return [(b, reconcile(f, b)) for b, f in zip(base, found, strict=True)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one, by the first's kind) replaced by its kind in angle brackets."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per input row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the fixed patterns' spans), spans (all, as kind:start:end), masked (the text without them, if asked for), and the columns ``keep``.

    Spans are in code points, by kind, then start, comma-joined. Fixed patterns apply to the whole text. The network's
    spans are added where they overlap no fixed one. A null or empty text has none (its masked text stays null). Null ids
    and repeated rows are kept. Columns of ``keep`` named like a result's are called k0, k1, ...; others are not used; an empty
    table gives an empty result. A text is held whole, with two bytes a character; its windows are decoded 4,096 at a time. A
    span may be longer than a window: tags are joined over windows, each character's from the window whose middle is nearest.
    """
    net = trained()
    kinds, names = dict(df.dtypes), [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                known = list(dict.fromkeys(t for t in texts if t))
                got = dict(zip(known, find_spans(known, net), strict=True))
                both = [got.get(t, ([], [])) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in both], pa.int64()) for k in range(len(KINDS))]
                columns = [part.column(0), *counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in both]), pa.array([listed(a) for _, a in both], pa.string())]
                if mask:
                    columns.append(pa.array([masked(t, a) if t else t for t, (_, a) in zip(texts, both, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(2 + i) for i in range(len(keep)))], names=out)

    out = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["masked"] * mask, *names]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", masked string" * mask + "".join(f", {n} {kinds[k]}" for n, k in zip(names, keep, strict=True))
    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)])
    return given.mapInArrow(run, schema).withColumnsRenamed({n: k for n, k in zip(names, keep, strict=True) if k not in out})
