from __future__ import annotations

import hashlib
import re

import numpy as np

from tidewater.llm import minhash, queries


def edited(docs):
    """docs: sorted (id, text)."""
    out = []
    for i, (d, t) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1] or "", len(t or "") // 2
        out.append((d, (t or "")[: len(t or "") - half] + after[:half]))
    return out


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(got, docs):
    of = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    errors = []
    for i, ((d, text), (_, other)) in enumerate(zip(docs, edited(docs), strict=True)):
        r, text = of[d], text or ""
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert re.fullmatch("[0-9a-f]{256}", r.fingerprint)
        errors += [r.near_edited - jaccard(text, other), r.near_next - jaccard(text, docs[(i + 1) % len(docs)][1] or "")]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if other == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    return np.array(errors)


def test_query_against_exact_likeness(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    errors = check(queries.op8_minhash(spark, small).collect(), docs)
    assert np.abs(errors).max() < 0.25 and errors.std() < 0.05 and abs(errors.mean()) < 0.01


def test_equal_texts_and_neighbours_over_buckets(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4, rng.integers(0, 30))) for _ in range(40)]
    docs = [(int(i) * 3 - 500, texts[rng.integers(0, 40)]) for i in range(700)]
    got = minhash.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    check(got, docs)
    prints = {}
    for r in got:
        prints.setdefault(dict(docs)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "é中\U0001f600"), (6, "w " * 100_000), (7, "a b c d e"), (8, "a b c d e")]
    make = lambda rows: spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, next string, bucket int")
    got = minhash.edited_fingerprints(make(docs)).collect()
    check(got, docs)
    more = minhash.edited_fingerprints(make([*docs, (None, "x y"), (None, None), (8, "a b c d e")])).collect()
    assert len(more) == 11
    lone = next(r for r in more if r.doc_id is None and r.n_chars == 3)
    assert lone.edited_sha256 == hashlib.sha256(b"x ").hexdigest() and lone.near_next == 0
    assert len(minhash.edited_fingerprints(make(docs[6:7])).collect()) == 1
    assert minhash.edited_fingerprints(make([(None, "a")])).count() == 1
    assert minhash.edited_fingerprints(make([])).count() == 0
