"""Repeated ids, ties and odd values in the operators of the earlier rounds."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelake.llm import chat, langid, mixing, mtree, quality, sharding
from tests.llm.test_llm import prose, water

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_queries_with_many_vectors_of_one_id(spark):
    rng = np.random.default_rng(3)
    vec = rng.integers(-900, 900, (90, 6)).tolist()
    rows = [(100, v) for v in vec[:31]] + [(200 + i, v) for i, v in enumerate(vec[31:])] + [(100, vec[0]), (300, vec[0])]
    data = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    asked = data.filter("vec_id % 100 = 0")
    got = defaultdict(list)
    for r in sorted(mtree.top_k(data, asked, cells=5, tree_rows=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    unique = sorted({(i, tuple(v)) for i, v in rows})
    for q in (100, 200, 300):
        pairs = sorted((-int(np.dot(a, b)), j) for i, a in unique if i == q for j, b in unique if j != q)
        assert got[q] == pairs[:10]


def test_huge_components_do_not_fail(spark):
    rows = [(100, [1e300, 1.0]), (200, [-1e300, 2.0]), (300, [1.5, 1e18]), (400, [0.0, 0.0])]
    data = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in mtree.top_k(data, data).collect()}
    assert len(got) == 12 and got[100, 200] == -got[100, 300] * 0 - mtree.MOST and got[400, 100] == 0


@pytest.mark.parametrize("ids", [40, 300])
def test_mixing_rounds_rows_of_one_id_apart(spark, ids):
    rng = np.random.default_rng(ids)
    rows = []
    for i in range(400):
        source = f"s{rng.integers(0, 4)}"
        rows.append((int(rng.integers(0, ids)) if i % 5 else None, prose(i % 150, 5 + int(rng.integers(0, 400))), "en", source, 0))
    rows += [rows[7]] * 60
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(rows) and got.copies.max() <= 2
    totals = got.groupby("source")["size"].sum().to_dict()
    for source, target in water(totals).items():
        assert abs(got[got.source == source].taken.sum() - target) <= 0.005 * target + 20
    assert (got.sort_values(got.columns.tolist()).reset_index(drop=True)
            .equals(mixing.mixed(docs).toPandas().sort_values(got.columns.tolist()).reset_index(drop=True)))
    out = mixing.repeated(docs.withColumn("_place", F.lit(1)))
    assert out.columns == docs.columns + ["_place"]
    found = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert sum(found.values()) == got.copies.sum() and max(found[k] - 2 * n for k, n in Counter(r[:2] for r in rows).items()) <= 0


def test_ties_of_turns_are_ordered_by_text(spark):
    rows = [(1, 0, "user", "a b"), (1, 0, "user", "a"), (1, 0, None, "z"), (1, 0, "user", 'a"'), (2, 0, "user", "x" * 3_000_000)]
    got = {r["conv_id"]: r for r in chat.digests(chat.text_parts(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    whole = "\nz\nuser\na\nuser\na b\nuser\na\"\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(("user\n" + "x" * 3_000_000 + "\n").encode()).hexdigest()


def test_attachments_beside_odd_texts(spark):
    none = dict.fromkeys(("kind", "text", "uri", "width", "height", "seconds", "pages"))
    parts = [none | {"kind": "text", "text": "a\0b<|image:0|>"}, none | {"kind": "image", "width": -3, "height": 0},
             none | {"kind": "audio", "seconds": float("nan")}, none | {"kind": "audio", "seconds": float("inf")},
             none | {"kind": "audio", "seconds": -4.0}]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = chat.digests(df).first()
    said = "a\0b<|image:0|>"
    assert (got["loss_chars"], got["attachments"], got["attachment_tokens"]) == (len(said), 4, 4)
    assert got["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_a_group_that_a_shard_holds_stays_together(spark):
    rows = [(i, prose(i, 30), "en", "s", 0) for i in range(1440)] + [(9000 + i, "equal words " * 8, "en", "s", 0) for i in range(60)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS)).toPandas()
    assert got[got.doc_id >= 9000].shard.nunique() == 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.05 * sizes.mean() and got.groupby("shard").size().max() < 1.15 * len(got) / 8


def test_a_group_above_a_shard_is_cut_and_null_ids_are_dealt(spark):
    rows = [(i, prose(i, 30), "en", "s", 0) for i in range(2000)]
    rows += [(None if i % 2 else 9000 + i, "equal words " * 8, "en", "s", 0) for i in range(1000)]
    got = sharding.sharded(spark.createDataFrame(rows, DOCS)).toPandas()
    assert got[got["size"] == 97].shard.nunique() == 8
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() < 1.05 * sizes.mean() and got.groupby("shard").size().max() < 1.2 * len(got) / 8
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def place_brute(items, shards):
    total = [sum(x[d] for x in items) or 1 for d in range(len(items[0]))]
    unit = [[v / t for v, t in zip(x, total)] for x in items]
    left, out = [[1 / shards] * len(total) for _ in range(shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda k: (-max(unit[k]), k)):
        fit = [s for s in range(shards) if all(a >= b - 1e-12 for a, b in zip(left[s], unit[i]))]
        fit = fit or [s for s in range(shards) if left[s][0] >= unit[i][0] - 1e-12]
        if fit:
            best = max(fit, key=lambda s: (round(sum(a * b for a, b in zip(left[s], unit[i])), 15), -s))
        else:
            best = max(range(shards), key=lambda s: (left[s][0], -s))
        left[best] = [a - b for a, b in zip(left[best], unit[i])]
        out[i] = best
    return out


def test_place_against_plain_loops():
    rng = np.random.default_rng(8)
    for n in (1, 7, 60, 300):
        items = rng.integers(1, 1000, (n, 3)) ** 2
        assert sharding.place(items.astype(float), 5).tolist() == place_brute(items.tolist(), 5)


def test_samples_are_bounded_for_repeated_ids(spark):
    rows = [(7, prose(i, 12), "en", "s", 0) for i in range(400)] + [(7, prose(1, 12), "en", "s", 0)] * 50
    rows += [(i, prose(i, 12), "de", "s", 0) for i in range(100, 140)] + [(8, None, "de", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    seen = []
    kept = langid.fit
    langid.fit = lambda got, bits, **k: (seen.append(Counter(x[2] for x in got)), kept(got, bits, **k))[1]
    try:
        langid.train(docs, F.lit(True), per_lang=30)
    finally:
        langid.fit = kept
    assert max(seen[0].values()) <= 30 and set(seen[0]) == {"en", "de"}
    labels = spark.createDataFrame([(7, 1), (101, 0)], "doc_id long, quality int")
    boost = quality.boost
    quality.boost = lambda x, y, **k: (seen.append(len(x)), boost(x, y, **k))[1]
    try:
        quality.train(docs, labels, F.lit(True), rows=5)
    finally:
        quality.boost = boost
    assert seen[1] <= 5


def boost_brute(x, y, trees, depth, rate=0.15, ridge=1.0, least=5.0, bins=64):
    """Scores of trees grown by trying every cut of every node."""
    share = (y.sum() + 1) / (len(y) + 2)
    raw = np.full(len(y), np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                return {int(r): -rate * g[rows].sum() / (h[rows].sum() + ridge) for r in rows}
            best, cut = 1e-9, None
            for j, edge in enumerate(edges):
                for e in edge:
                    low = x[rows, j] <= e
                    hl, hr = h[rows][low].sum(), h[rows][~low].sum()
                    if hl < least / 4 or hr < least / 4:
                        continue
                    gl, gr = g[rows][low].sum(), g[rows][~low].sum()
                    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                    if gain > best + 1e-12:
                        best, cut = gain, low
            if cut is None:
                return grow(rows, level + 1)
            return grow(rows[cut], level + 1) | grow(rows[~cut], level + 1)

        step = grow(np.arange(len(y)), 0)
        raw += np.array([step[i] for i in range(len(y))])
    return 1 / (1 + np.exp(-raw))


def test_boosting_against_every_cut():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    got = quality.boost(x, y, trees=5, depth=2).score(x)
    assert np.allclose(got, boost_brute(x, y, 5, 2), atol=1e-9)


def test_two_permutations():
    from platelake.llm import neardup

    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_521)
    one, two = neardup.permute(x.copy(), neardup.FIRST), neardup.permute(x.copy(), neardup.SECOND)
    assert len(np.unique(one)) == len(np.unique(two)) == len(x) and (one == two).mean() < 0.001
    # Coordinates estimate the Jaccard similarity, and neighbouring ones are not the same estimate.
    rng = np.random.default_rng(1)
    near = []
    for _ in range(60):
        a = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
        b = np.concatenate([a[:260], rng.integers(0, 2 ** 63, 40, dtype=np.uint64)])
        near.append(neardup.signature(a) == neardup.signature(b))
    near = np.array(near)
    assert abs(near.mean() - 260 / 340) < 0.02
    assert abs(np.corrcoef(near[:, :-1].ravel(), near[:, 1:].ravel())[0, 1]) < 0.1


def test_the_exact_join_removes_false_hits(spark):
    from platelake.llm import urls

    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/p"), "id").alias("url"))
    listed = pages.filter("page_id % 3 = 0").select("url")
    keys = listed.select(urls.canonical(F.col("url")).alias("key"))
    rows, blocks = urls.bloom(keys, "key")
    assert blocks > 200 and rows.count() > 200
    got = urls.judged(pages, listed).groupBy("listed", "verdict").count().collect()
    assert {(r["listed"], r["verdict"]): r["count"] for r in got} == {(True, "block"): 10_000, (False, "allow"): 20_000}
    key = F.concat(F.lit("h.net/p"), "page_id")
    probes = pages.filter("page_id % 3 > 0").withColumn("key", key).withColumn("block", urls._block(F.col("key"), blocks)).join(rows, "block")
    hit = F.lit(True)
    for i in range(urls.WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(urls._bit(F.col("key"), i)) != 0)
    assert 0 < probes.filter(hit).count() < 600
    assert urls.judged(pages.limit(0), listed).count() == 0 and urls.judged(pages.limit(7), listed.limit(0)).count() == 7


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    schema = DOCS + ", score double, key string, row string, extra map<string,int>"
    base = [(i, prose(i % 25, 40 + i), "en", f"s{i % 3}", 0, 0.5, "k", "r", {"a": i}) for i in range(60)]
    rows = base + [base[3]] * 3 + [(None, base[4][1], *base[4][2:]), (None, prose(99, 50), None, None, None, None, None, None, None),
                                   (200, None, "en", None, 0, 0.0, "", "", {}), (201, "", "en", "s0", 0, 0.0, "", "", {}),
                                   (202, "?! 12", "en", "s0", 0, 0.0, "", "", {})]
    for name, docs in (("full", rows), ("none", [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels = [(i, 1) for i in range(60)] + [(None, 1), (3, None)] if docs else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int" if not docs else "doc_id long, quality int").write.parquet(
            f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        after = cp.stored(stage(spark, docs, f"{tmp_path}/full"), "odd")
        assert after.columns == docs.columns
        if name == "language ID":
            assert {200, 201, 202}.isdisjoint(r.doc_id for r in after.select("doc_id").collect()) and after.count() == 65
        if name == "MinHash near-dedup":
            ids = [r.doc_id for r in after.select("doc_id").collect()]
            assert max(Counter(i for i in ids if i is not None).values()) == 1
        docs = after
    assert cp.STAGES[-1][1](spark, docs, f"{tmp_path}/full").count() > 0
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
