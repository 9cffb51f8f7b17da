from __future__ import annotations

import hashlib
import re

import numpy as np

from tidewater.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(CARD, text) if 13 <= len(digits(m)) <= 19 and plain_luhn(digits(m))]
    out += [(3, m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return out


def test_patterns_equal_brute_force():
    rng = np.random.default_rng(7)
    for letters in ("a@.1 ", "1.2+-() 3", "a.@@b-1", "0123456789. -+()@a"):
        for _ in range(3000):
            text = "".join(rng.choice(list(letters), rng.integers(0, 40)))
            assert pii.base_spans(text) == brute(text), text
    for text, _ in pii.labelled(300, seed=12):
        assert pii.base_spans(text) == brute(text)


def test_patterns_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "@" * 200_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_gradients():
    net, rng = pii.Network(1), np.random.default_rng(0)
    codes, tags = rng.integers(0, pii.CODES, (3, 6)), rng.integers(0, pii.TAGS, (3, 6))
    _, grads = net.gradients(codes, tags)
    for name, grad in grads.items():
        at, step = np.unravel_index(np.abs(grad).argmax(), grad.shape), 1e-2
        before = net.p[name][at]
        values = []
        for sign in (1, -1):
            net.p[name][at] = before + sign * step
            values.append(net.gradients(codes, tags)[0])
        net.p[name][at] = before
        assert abs((values[0] - values[1]) / 2 / step - grad[at]) < 0.02


def test_network_on_held_out_lines():
    rows = pii.labelled(300, seed=99)
    got = pii.find_spans([t for t, _ in rows], pii.trained())
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    found = {(i, *s) for i, (_, spans) in enumerate(got) for s in spans}
    base = {(i, *s) for i, (spans, _) in enumerate(got) for s in spans}
    assert base <= found
    assert len(want & found) / len(want) > 0.85 and len(want & found) > len(want & base)


def test_windows_agree_over_long_texts():
    net, filler = pii.trained(), "on the thing and ered "
    line = "write to jo (at) mail.example.com or (269) 555-3296 ok "
    short = pii.find_spans([filler * 9 + line], net)[0][1]
    text = (filler * 40 + line) * 30
    got = pii.find_spans([text], net)[0][1]
    assert len(short) and len(got) == 30 * len(short)
    dense = "4111 1111 1111 1111, " * 300
    assert len(pii.find_spans([dense], net)[0][1]) == len(pii.base_spans(dense)) == 300


def test_windows_cover_all_that_can_hold_a_span():
    for text, spans in pii.labelled(400, seed=31):
        filler = "on the thing and ered " * 12
        whole, shift = filler + text + filler, len(filler)
        covered = np.zeros(len(whole), bool)
        counted = np.zeros(len(whole), int)
        for at, low, high in pii.windows(whole, pii.encode(whole)):
            covered[at : at + pii.WINDOW] = True
            counted[at + low : min(at + high, at + pii.WINDOW)] += 1
        for _, a, b in spans:
            assert covered[a + shift : b + shift].all()
        assert (counted[covered] == 1).mean() > 0.99 and counted.max() <= 2


class RunsOfDigits:
    """A network that marks each run of digits and dashes as a phone number, as far as a window shows it."""

    def decode(self, codes):
        run = (codes == 1) | (codes == pii.encode("-")[0])
        start = run & ~np.concatenate((np.zeros((len(run), 1), bool), run[:, :-1]), 1)
        return np.where(start, 7, np.where(run, 8, 0)).astype(np.int8)


def test_spans_longer_than_the_overlap_of_windows():
    number = "1------" * 10  # 70 characters, more than windows share
    for pad in range(100):
        text = "ab " * 40 + "x" * pad + " " + number + " ok " + "ab " * 30
        at = text.index(number)
        assert (3, at, at + 70) in pii.find_spans([text], RunsOfDigits())[0][1], pad
    long = "a" * 30_000 + "7" + "b" * 30_000
    assert len(pii.windows(long, pii.encode(long))) < 1300


def test_reconcile_equals_the_plain_rule():
    rng = np.random.default_rng(2)
    for _ in range(400):
        draw = lambda n: [(int(k), int(a), int(a + w)) for k, a, w in zip(rng.integers(0, 4, n), rng.integers(0, 60, n), rng.integers(1, 12, n), strict=True)]
        base, found = sorted(draw(3)), [(s, 1) for s in draw(12)]
        votes = {s: sum(x == s for x, _ in found) for s, _ in found}
        taken = [(a, b) for _, a, b in base]
        want = list(base)
        for s in sorted(votes, key=lambda s: (-votes[s], s[1] - s[2], s[1], s[0])):
            if all(s[2] <= a or b <= s[1] for a, b in taken):
                taken.append((s[1], s[2]))
                want.append(s)
        assert pii.reconcile(found, base) == sorted(want)


def test_query_and_odd_rows(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op10_pii(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute(docs[r.doc_id] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert {x for x in text.split(",") if x} <= set(r.spans.split(","))
    texts = [None, "", " ", "a@b.co", "é中\U0001f600 10.0.0.1 x", "1" * 100_000, "x a@b.co, +1 (269) 555-3296 " * 3000]
    df = spark.createDataFrame([(None if i == 2 else i, t, "clash", 3) for i, t in enumerate(texts)] * 2, "doc_id long, text string, spans string, n_ip int")
    rows = pii.find(df, mask=True, keep=("spans", "n_ip")).collect()
    assert len(rows) == 14
    by = {r.doc_id: r for r in rows}
    assert by[0].masked is None and by[1].masked == "" and by[3].masked == "<EMAIL>" and by[4].masked == "é中\U0001f600 <IP> x"
    assert (by[6].n_email, by[6].n_phone) == (3000, 3000) and "@" not in by[6].masked
    assert pii.find(df.limit(0)).count() == 0
