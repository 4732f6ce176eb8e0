"""Models and limits that come from all rows."""

import numpy as np
from pyspark.sql import functions as F

from platelake.llm import langid, quality
from tests.llm.test_llm import prose


def test_language_learns_from_rows_beyond_a_sample(spark):
    odd = {"en": "qqxj zzvk jjxq", "de": "wwpf kkbd ffpw"}
    ids = spark.range(1400).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    rows, met = [], {"en": 0, "de": 0}
    for i in ids:
        lang = "en" if i % 2 else "de"
        met[lang] += 1
        rows.append((i, prose(i, 12) if met[lang] <= 600 else odd[lang], lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    asked = spark.createDataFrame([(lang, text) for lang, text in odd.items()], "lang string, text string")
    got = langid.identify(asked, langid.train(docs, F.lit(True))).collect()
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in got)
    few = langid.identify(asked, langid.train(docs, F.lit(True), per_lang=600)).collect()
    assert not all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in few)


def test_tallies_count_every_row_once(spark):
    rows = [(prose(i, 5 + i % 7), f"l{i % 3}", i % langid.FOLDS) for i in range(90)] + [("12 34", "l9", 0)]
    langs, sums = langid.tallies(spark.createDataFrame(rows, "text string, lang string, fold int").repartition(5), 12)
    assert langs == ["l0", "l1", "l2"]
    want = np.zeros_like(sums)
    for text, lang, fold in rows[:90]:
        ids, share = langid.shares(text, 12)
        want[fold, langs.index(lang), ids] += share
    assert np.allclose(sums, want, atol=1e-5) and np.allclose(sums.sum(), 90, atol=1e-3)


def test_more_languages_than_dimensions(spark):
    rng = np.random.default_rng(5)
    words = {f"l{k:02}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(12)] for k in range(20)}
    rows = [(" ".join(rng.choice(words[f"l{i % 20:02}"], 15)), f"l{i % 20:02}") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = langid.identify(docs, langid.train_on_all(docs, F.lit(True))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_quality_learns_from_rows_beyond_a_sample(spark):
    ids = spark.range(6600).orderBy(F.xxhash64("id")).toPandas()["id"].tolist()
    shouted = prose(9, 20).upper()
    rows = [(i, prose(i, 20) if k % 2 else "#$ 12 " * 9, k % 2) if k < 6000 else (i, prose(i, 20).upper(), 0)
            for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    labels, docs = docs.select("doc_id", "quality"), docs.select("doc_id", "text")
    asked = spark.createDataFrame([(shouted,), (prose(9, 20),)], "text string")
    trees, limit = quality.train_with_limit(docs, labels, F.lit(True))
    bad, good = (r[0] for r in asked.select(quality.scored(trees, F.col("text"))).collect())
    assert bad < limit <= 0.5 < good
    few = quality.train(docs, labels, F.lit(True))
    assert asked.select(quality.scored(few, F.col("text"))).first()[0] > 0.5


def test_spread_boosting_equals_boosting_in_memory(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 10, (600, len(quality.FEATURES))).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > rng.integers(2, 7, 600))).astype(float)
    fold = rng.integers(0, quality.FOLDS, 600)
    rows = [(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold)]
    points = spark.createDataFrame(rows, "x array<double>, label int, fold int").repartition(3)
    trees, scores = quality.boost_spread(points, trees=4, depth=3)
    assert np.allclose(trees.score(x), quality.boost(x, y, trees=4, depth=3).score(x), atol=1e-9)
    want = []
    for m in range(quality.FOLDS):
        left = quality.boost(x[fold != m], y[fold != m], trees=4, depth=3)
        want += list(zip(y[fold == m], left.score(x[fold == m])))
    got = [(a, b) for label, score in scores.collect() for a, b in zip(label, score)]
    assert np.allclose(sorted(got), sorted(want), atol=1e-9)


def test_quality_limit_without_both_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 9)) for i in range(9)], "doc_id long, text string")
    for rows, good in (([], False), ([(1, 1), (2, 1)], True), ([(1, 0), (2, 0)], False), ([(1, 1), (2, 0)], True)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        trees, limit = quality.train_with_limit(docs, labels, F.lit(True))
        assert (0 < limit <= 0.5) if good else limit == 0.0
        assert all(0 < r[0] < 1 for r in docs.select(quality.scored(trees, F.col("text"))).collect())
