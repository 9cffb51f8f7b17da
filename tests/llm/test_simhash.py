from __future__ import annotations

import re

import numpy as np
import xxhash

from tidewater.llm import queries, simhash


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, distance=3):
    values = np.array(prints, np.uint64)
    of = list(range(len(values)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(v ^ values) <= distance):
            a, b = find(i), find(int(j))
            of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_query_equals_brute_force(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in docs]
    want = {(d, f"{p:016x}", docs[g][0]) for (d, _), p, g in zip(docs, prints, brute_groups(prints), strict=True)}
    assert {tuple(r) for r in queries.op1_simhash(spark, small).collect()} == want


def test_large_buckets_keep_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    near = {int(base)}
    for _ in range(1500):
        v = base
        for bit in rng.integers(0, 64, rng.integers(0, 6)):
            v ^= np.uint64(1) << np.uint64(bit)
        near.add(int(v))
    near |= {int(v) for v in rng.integers(0, 2**63, 300, dtype=np.uint64)}
    values = np.array(sorted(near), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    groups = brute_groups(values)
    want = {}
    for v, g in zip(values.view(np.int64).tolist(), groups, strict=True):
        want.setdefault(g, set()).add(v)
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    for bucket in (8, 65_536):
        got = {}
        for r in simhash.linked(df, 3, bucket).collect():
            got.setdefault(r.root, {r.root}).add(r.node)
        assert {frozenset(g) for g in got.values()} == want


def test_bucket_cut_equals_all_pairs():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**11, 3000, dtype=np.uint64) << np.uint64(5))
    root = lambda a, b: simhash._roots(len(values), a, b).tolist()
    assert root(*simhash.link_bucket(values, 3, (0, 32))) == root(*simhash._pairs(values, np.zeros(len(values)), 3, len(values)))


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (None, "a b c d"), (7, "A b C d"), (7, "A b C d"), (8, "x " * 60_000), (1, "one")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    want = sorted([(i, f"{brute_print(t):016x}", 4 if not (t or "").split() else 7 if t and "d" in t else i) for i, t in rows], key=str)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
