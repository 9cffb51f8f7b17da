from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import mixing, neardup


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates_against_exact_likeness(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{int(rng.zipf(1.3)) % 3000}"
    docs, i = [], 0
    for _ in range(120):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        for edits in (0, 0, 1, 2, 0.02, 0.5):
            words = list(base)
            for at in rng.integers(0, len(words), int(edits if edits >= 1 else edits * len(words))):
                words[at] = word()
            docs.append((i, " ".join(words)))
            i += 1
    sets = {d: shingles(t) for d, t in docs}
    got = found(spark, docs)
    near = far = hit = wrong = 0
    for a in range(0, len(docs), 6):
        for x in range(a, a + 6):
            for y in range(a, x):
                likeness = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
                together = got[x] == got[y]
                near, hit = near + (likeness >= 0.8), hit + (likeness >= 0.8 and together)
                far, wrong = far + (likeness < 0.6), wrong + (likeness < 0.6 and together)
    assert hit / near > 0.97 and wrong == 0 and far > 100
    assert all(g // 6 == d // 6 for d, g in got.items())


def test_links_are_decided_on_all_shingles(spark):
    rng, docs, pairs = np.random.default_rng(4), [], []
    for k in range(160):
        base = [f"w{x}" for x in rng.integers(0, 50_000, 900)]
        other = list(base)
        for at in rng.choice(900, (22, 18)[k % 2], replace=False):
            other[at] = f"x{k}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = shingles(docs[-2][1]), shingles(docs[-1][1])
        pairs.append(len(a & b) / len(a | b))
    got = found(spark, docs)
    under = [k for k, j in enumerate(pairs) if 0.75 < j < 0.8]
    over = [k for k, j in enumerate(pairs) if j >= 0.8]
    assert len(under) > 40 and len(over) > 40
    together = {k for k in range(len(pairs)) if got[2 * k] == got[2 * k + 1]}
    assert not together.intersection(under)
    assert len(together.intersection(over)) > 0.9 * len(over)


def exact_groups(docs, threshold=0.8):
    """Smallest id of each document's component of links, by comparing all pairs."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for x in range(len(docs)):
        for y in range(x):
            if min(len(sets[x]), len(sets[y])) >= threshold * max(len(sets[x]), len(sets[y])) and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                pairs += 1
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {docs[x][0]: docs[find(x)][0] for x in range(len(docs))}, pairs


def found(spark, docs, parts=8):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r.group for r in neardup.groups(df).collect()}
    return {d: got.get(d, d) for d, _ in docs}


def test_large_groups_of_near_copies_stay_whole(spark):
    rng = np.random.default_rng(3)
    docs, bases = [], []
    for size, copies in ((300, 500), (300, 200), (1200, 120)):
        bases.append([f"w{x}" for x in rng.integers(0, 5000, size)])
        for k in range(copies):
            words = list(bases[-1])
            for at in rng.integers(0, size, 3):
                words[at] = f"x{len(docs)}"
            docs.append((len(docs), " ".join(words)))
    other = list(bases[2])
    other[100:205] = [f"y{k}" for k in range(105)]  # a second version of the last text, likeness near 0.84
    for k in range(120):
        words = list(other)
        words[int(rng.integers(0, 100))] = f"x{len(docs)}"
        docs.append((len(docs), " ".join(words)))
    want, _ = exact_groups(docs)
    assert len(set(want.values())) == 3 and found(spark, docs) == want
    kept = neardup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == set(want.values()) and len(kept) == 3


def test_neighbours_that_fail_hide_no_link(spark):
    """Versions around the threshold: most near pairs fail, and what links isn't among the nearest."""
    rng, docs = np.random.default_rng(12), []
    for base in range(12):
        words = [f"b{base}w{x}" for x in rng.integers(0, 400, 200)]
        for _ in range(30):
            mine = list(words)
            for at in rng.choice(200, int(rng.integers(1, 8)), replace=False):
                mine[at] = f"z{int(rng.integers(0, 3))}"
            docs.append((len(docs), " ".join(mine)))
    want, pairs = exact_groups(docs)
    got = found(spark, docs)
    assert pairs > 300 and sum(got[d] == want[d] for d, _ in docs) >= 0.98 * len(docs)
    assert found(spark, docs, 3) == got


def test_recall_of_block_edits(spark):
    rng, docs, pairs = np.random.default_rng(6), [], []
    for k in range(400):
        size = int(rng.choice([80, 160, 400, 900]))
        base = [f"w{x}" for x in rng.integers(0, 3000, size)]
        cut, at = int(size * rng.uniform(0.01, 0.12)), int(rng.integers(0, size))
        other = base[:at] + [f"w{x}" for x in rng.integers(0, 3000, cut)] + base[at + cut :]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = shingles(docs[-2][1]), shingles(docs[-1][1])
        pairs.append(len(a & b) / len(a | b))
    got = found(spark, docs)
    together = [got[2 * k] == got[2 * k + 1] for k in range(len(pairs))]
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 1.01, 0.96)):
        band = [t for t, j in zip(together, pairs, strict=True) if low <= j < high]
        assert len(band) > 60 and sum(band) >= least * len(band), (low, sum(band), len(band))
    assert not any(t for t, j in zip(together, pairs, strict=True) if j < 0.8)


def test_deduplicate_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(3, t), (2, t.upper()), (2, t.upper()), (None, t), (5, None), (6, ""), (7, " "), (8, "x"), (9, "x " * 50_000), (None, "a b"), (None, "a b"), (4, t + " eight")]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, group string, node int, row int")
    got = neardup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["2", "None", "4", "5", "6", "7", "8", "9"])
    groups = sorted(map(str, ((r.doc_id, r.group) for r in neardup.groups(df).collect())))
    assert groups == sorted(map(str, [(3, 2), (2, 2), (2, 2), (None, 2), (None, None), (None, None)]))
    assert neardup.deduplicate(df.limit(0)).count() == 0 and neardup.groups(df.where("text IS NULL")).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionAll(docs.limit(3)).unionAll(spark.createDataFrame([(9001, None, None, None, 0), (9002, " a  b\n", "en", None, 6)], docs.schema))
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert count == {r.doc_id: r.n for r in taken}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        whole, part = texts[r.doc_id].split(), r.text.split()
        at = 0
        for w in part:
            at = whole.index(w, at) + 1 if w in whole[at:] else -10**9
        assert at >= 0


def test_pipeline_runs(spark, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(sizes) > 50 and max(r.n for r in sizes) <= 2048


def test_pipeline_over_odd_and_empty_tables(spark, small, tmp_path):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(None, "", None, None, 0), (None, None, None, None, None), (7, None, "en", "src1", 0), (100_001, "w " * 60_000, None, "src1", 1), (100_002, "\x00 \ud7ff", "xx", None, 3)]
    more = docs.unionAll(docs.limit(20)).unionAll(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 AS node", "'x' AS key", "2 AS row", "doc_id AS b")
    for name, rows, known in (("odd", more, labels), ("none", more.limit(0), labels.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        known.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 50) == (name == "odd")


def test_mixed_rows_of_one_id_keep_their_own_words(spark):
    rows = [(1, f"{s}{k} " * 40, "en", s, 0) for s in "ab" for k in range(3)] + [(None, "n " * 30, None, None, 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in mixing.mixed_documents(docs).collect():
        assert set(r.text.split()) == {"n"} if r.source is None else all(w[0] == r.source for w in r.text.split()) and len(set(r.text.split())) == 1
