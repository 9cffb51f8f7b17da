from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import language, quality, queries


def test_language_held_out_accuracy(spark, tenth):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tenth}/documents.parquet").collect()}
    got = queries.op2_language(spark, tenth).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = rng.integers(1, 6), 3
        scores, switch = rng.normal(size=(n, k)) * 3, 2.0
        paths = np.stack(np.meshgrid(*[range(k)] * n, indexing="ij"), -1).reshape(-1, n)
        value = lambda p: scores[np.arange(n), p].sum() - switch * (np.diff(p) != 0).sum()  # noqa: B023, E731
        best = max(map(value, paths))
        assert np.isclose(value(language.viterbi(scores, switch)), best)
        top, sure = language.steady(scores, np.zeros(1, int), switch)
        assert not sure[0] or np.isclose(value(np.full(n, top[0])), best)


def test_steady_takes_documents_apart():
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(n, 4)) * 4 for n in (3, 1, 50, 7)]
    first = np.cumsum([0, 3, 1, 50])
    best, sure = language.steady(np.concatenate(parts), first, 9.0)
    for i, p in enumerate(parts):
        b, s = language.steady(p, np.zeros(1, int), 9.0)
        assert (best[i], sure[i]) == (b[0], s[0])


def test_language_spans_scripts_and_odd_rows(spark):
    en = "the cat and the dog with their house on that hill of the town " * 30
    de = "und der hund mit dem haus auf diesem berg von der stadt nicht " * 30
    ru = "кот и собака в доме на горе из города не так как они были " * 30
    rows = spark.createDataFrame([(i, t, k) for i in range(8) for t, k in ((en, "en"), (de, "de"), (ru, "ru"))] + [(1, None, "en"), (2, "x", None)], "id long, text string, lang string")
    model = language.train(rows)
    assert model.langs == ("de", "en", "ru")
    texts = [None, "", "123 !?", en[:120] + de[:120] + ru[:100], "кот", "THE CAT", "漢字", "the " * 300_000, "İ the cat"]
    df = spark.createDataFrame([(None if i == 4 else i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, spans int")
    got = {4 if r.doc_id is None else r.doc_id: r for r in language.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0 and got[2].spans == []
    assert [s.lang for s in got[3].spans] == ["en", "de", "ru"]
    assert abs(got[3].spans[1].start - 120) <= 8 and got[3].spans[2].end <= len(texts[3])
    assert (got[4].lang_pred, got[5].lang_pred, got[7].lang_pred, got[8].lang_pred) == ("ru", "en", "en", "en")
    assert got[6].lang_pred in model.langs
    assert language.identify(df.limit(0), model).count() == 0
    nothing = language.train(rows.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_quality_held_out(spark, tenth):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tenth}/labels.parquet").collect()}
    got = queries.op9_quality(spark, tenth).collect()
    assert len(got) == spark.read.parquet(f"{tenth}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in held if labels[r.doc_id] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_forest_arrays_equal_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.boost(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(quality.boost(x[:0], y[:0]).score(x), 0.5)


def test_quality_odd_rows(spark):
    texts = [None, "", " \n", "word", "!" * 200_000, "a b " * 50_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, 5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(0, 1), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    got = quality.score(docs, forest, keep=("score",)).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0
    assert spark.range(1).select(quality.held_out(F.lit(None).cast("long"), 4, 2)).first()[0] is False
