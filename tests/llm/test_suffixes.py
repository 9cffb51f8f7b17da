from __future__ import annotations

from collections import defaultdict

import numpy as np

from tidewater.llm import queries, suffixes


def brute(docs, size=suffixes.MIN):
    """Words of each document inside a run of ``size`` words that another document holds."""
    holders = defaultdict(set)
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            holders[tuple(w[i : i + size])].add(d)
    out = {}
    for d, t in docs:
        w = (t or "").encode().split()
        inside = {k for i in range(len(w) - size + 1) if len(holders[tuple(w[i : i + size])]) > 1 for k in range(i, i + size)}
        if inside:
            out[d] = inside
    return out


def words_of(row):
    return {k for s in row.passages.split(",") for k in range(*map(int, s.split(":")))}


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: words_of(r) for r in queries.op6_suffixes(spark, small).collect()}
    assert got == want and len(want) > 3


def test_planted_passages_over_partitions(spark):
    rng = np.random.default_rng(9)
    fill = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 100_000, n))
    passages = [fill(n) for n in (50, 51, 60, 75, 120, 400, 49, 30)]
    docs = []
    for i in range(400):
        docs.append((i, " ".join([fill(rng.integers(0, 80)), passages[rng.integers(8)], fill(rng.integers(0, 80)), passages[rng.integers(8)] if i % 3 == 0 else ""])))
    docs += [(1000 + i, docs[0][1]) for i in range(50)]
    docs += [(2000, " ".join(["same"] * 500)), (2001, fill(60) + " " + " ".join([passages[6]] * 5)), (2002, passages[0][: len(passages[0]) // 2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = suffixes.repeated_passages(df).collect()
    got, want = {r.doc_id: words_of(r) for r in rows}, brute(docs)
    assert got == want
    for r in rows:
        assert r.partner != r.doc_id and r.repeated_words == len(got[r.doc_id])
    kept = suffixes.without_repeats(df).collect()
    left = " ".join(r.text for r in kept)
    assert len(kept) == len(docs) and all(p in left for p in passages)
    assert sum(passages[5] in r.text for r in kept) < 20


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, "a  b\n" + text.replace(" ", "\t")), (None, text), (3, None), (4, ""), (5, "x " * 100_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, passages string, seed int")
    got = {r.doc_id: r.passages for r in suffixes.repeated_passages(df).collect()}
    assert got == {1: "0:60", 2: "2:62"}
    assert suffixes.repeated_passages(df.limit(0)).count() == 0
    assert suffixes.without_repeats(df).columns == df.columns


def exact(docs, size=suffixes.MIN):
    """For each document its repeated words, those that a smaller document holds, and the smallest partner."""
    holders, out = defaultdict(set), {}
    runs = [(d, i, tuple(w[i : i + size])) for d, t in docs for w in [t.split()] for i in range(len(w) - size + 1)]
    for d, _, run in runs:
        holders[run].add(d)
    for d, i, run in runs:
        others = holders[run] - {d}
        if others:
            words, later, partner = out.get(d, (set(), set(), d + 10**9))
            span = set(range(i, i + size))
            out[d] = (words | span, later | (span if min(others) < d else set()), min(partner, min(others)))
    return out


def found(df):
    spans = lambda text: {k for s in text.split(",") if s for k in range(*map(int, s.split(":")))}
    return {r.doc_id: (spans(r.passages), spans(r.removable), r.partner) for r in suffixes.repeated_passages(df).collect()}


def filler(seed):
    rng = np.random.default_rng(seed)
    return rng, lambda n: " ".join(f"w{k}" for k in rng.integers(0, 100_000, n))


def test_all_but_the_smallest_holder_lose_a_short_passage(spark, monkeypatch):
    rng, fill = filler(3)
    passages = [fill(n) for n in (50, 60, 75, 88)]
    docs = [(int(i), " ".join([fill(40), passages[k % 4], fill(40)])) for k, i in enumerate(rng.permutation(800))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = exact(docs)
    assert found(df) == want and len(want) == 800
    left = [r.text for r in suffixes.without_repeats(df).collect()]
    assert [sum(p in t for t in left) for p in passages] == [1] * 4
    monkeypatch.setattr(suffixes, "HOT", 20)  # the same by way of the aggregates
    assert found(df) == want


def test_a_passage_left_of_a_frequent_line(spark, monkeypatch):
    rng, fill = filler(27)
    docs = []
    for shared, line in ((10, 45), (20, 32), (15, 35), (5, 47), (23, 27)) * 8:
        common, before, pair = fill(line), fill(shared), set(rng.integers(0, 120, 2).tolist())
        for k in range(120):
            docs.append((len(docs), " ".join([fill(40), before if k in pair else fill(shared), common, fill(40)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = exact(docs)
    assert found(df) == want and len(want) >= 70
    monkeypatch.setattr(suffixes, "HOT", 20)
    assert found(df) == want


def test_passage_behind_a_frequent_seed_and_any_number_of_partitions(spark):
    """Two texts share 50 words; 38 others share only 27 of them, so the true partner isn't near in any order of the seed."""
    rng = np.random.default_rng(21)
    word = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(50)
    docs = [(0, " ".join(word(41) + passage + word(30))), (1, " ".join(word(7) + passage + word(60)))]
    docs += [(2 + k, " ".join(word(20) + passage[(k % 23) : (k % 23) + 27] + word(40))) for k in range(38)]
    found = []
    for parts in (2, 7, 211):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        found.append(sorted(map(tuple, got)))
    assert found[0] == found[1] == found[2]
    assert [(r[0], r[3], r[5]) for r in found[0]] == [(0, "41:91", 1), (1, "7:57", 0)]


def test_copies_behind_a_frequent_seed_are_not_listed_window_by_window(spark, monkeypatch):
    rng, fill = filler(31)
    passages = [fill(n) for n in (400, 250)]
    docs = [(int(i), " ".join([fill(30), passages[k % 2], fill(30)] if k % 5 else [passages[0], passages[0]])) for k, i in enumerate(rng.permutation(200))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(suffixes, "HOT", 20)
    want = exact(docs)
    assert found(df) == want and len(want) == 200
    size, holders = suffixes.MIN, defaultdict(set)
    runs = [(d, tuple(w[i : i + size])) for d, t in docs for w in [t.split()] for i in range(len(w) - size + 1)]
    for d, run in runs:
        holders[run].add(d)
    shared = sum(len(holders[run]) > 1 for _, run in runs)
    assert suffixes.repeats(df).count() < shared / 4
