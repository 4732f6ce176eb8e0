"""Toxicity, whitening and token alignment against brute force, with awkward rows."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelake.llm import crosstok, queries, toxicity, whitening
from tests.llm.test_llm import prose

TOXIC = "text string, doc_id long, label int, lang string, source string, score double, words int, h long, stem string"


def test_folding():
    assert toxicity.folded_words("Ѕtuріd idi0t m0r0n!! l0́ser $cum ＦＯＯ st​upid loser$$$") == [
        "stupid", "idiot", "moron", "loser", "scum", "foo", "stupid", "loser"]
    assert toxicity.folded_words("2024 3.50 a_b Straße\tgrün") == ["a", "b", "strasse", "grun"] or \
        toxicity.folded_words("2024 3.50 a_b Straße\tgrün") == ["a", "b", "straße", "grun"]
    assert toxicity.folded_words(None) == toxicity.folded_words("") == toxicity.folded_words("12 !! 7") == []


def brute_hits(lexicon, text):
    """Every word against every entry, one after the other."""
    words = toxicity.folded_words(text)
    free = set()
    for phrase in lexicon.exceptions:
        p = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                free.update(range(i, i + len(p)))
    total = 0.0
    for i, w in enumerate(words):
        if i not in free:
            total += max([x for e, x in lexicon.entries if (w + " ").startswith(e)], default=0.0)
    return total, len(words)


def test_automaton_against_plain_matching():
    lexicon = toxicity.Lexicon((("bad", 2.0), ("badly ", 5.0), ("trash ", 3.0), ("wor", 1.0), ("worst", 4.0)),
                               ("trash can", "wordy", "bad bad day"), 2.0, 3.0)
    rng = np.random.default_rng(0)
    pool = "bad badly badlyx trash can wordy words worst abad day Trаsh w0rst".split()
    for n in range(200):
        text = " ".join(pool[i] for i in rng.integers(0, len(pool), n % 23))
        assert lexicon.hits(text) == pytest.approx(brute_hits(lexicon, text))
    assert lexicon.of("") == lexicon.of(None) == lexicon.score(0.0) < lexicon.of("bad")


def test_toxicity_learns_stems_not_copies(spark):
    """Inflected words, one text copied many times, a clean word that begins like a toxic one, disguises."""
    rng = np.random.default_rng(5)
    rows, ends = [], ["", "en", "ix", "or", "ata", "umi"]
    for i in range(700):
        words = prose(i, 60, [f"w{c}{d}a" for c in "abcdefghij" for d in "klmnop"]).split()
        if i % 4 == 0:
            for at in rng.integers(0, 60, 6):
                words[at] = ("zork" if i % 8 else "glab") + ends[rng.integers(0, 6)]
        elif i % 3 == 0:
            words[5] = "zorkelman"
        rows.append((" ".join(words), i, int(i % 4 == 0)))
    copied = prose(9999, 60, [f"v{c}{d}" for c in "abcdefghij" for d in "klmnop"]) + " zorken zorkix zorkor"
    rows += [(copied.replace("va", f"va{'x' * (i % 3)}", i % 4), 5000 + i, 1) for i in range(200)]
    docs = spark.createDataFrame([(t, i, k, None, None, 1.0, 2, 3, "q") for t, i, k in rows], TOXIC)
    labels = spark.createDataFrame([(i, k) for _, i, k in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels, F.lit(True))
    names = {e for e, _ in lexicon.entries}
    assert any(e.startswith("glab") for e in names) and any(e.startswith("zork") for e in names)
    assert not any(e.startswith("v") for e in names)
    clean, bad = prose(77, 60, ["wakaa", "wblaa"]), prose(77, 40, ["wakaa", "wblaa"])
    assert lexicon.of(clean + " zorkelman") < 0.5 < lexicon.of(bad + " zorkata glabumi zorken")
    assert lexicon.of(bad + " z0rkata gl@bumi zоrken") == lexicon.of(bad + " zorkata glabumi zorken")
    got = docs.select("label", toxicity.scored(lexicon, F.col("text")).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.7) == bool(r["label"]) for r in got]) > 0.98


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([("a b", 1, 0, None, None, 0.0, 0, 0, ""), (None, 2, 0, None, None, 0.0, 0, 0, "")], TOXIC)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, none, F.lit(True))
    assert {r[0] for r in docs.select(toxicity.scored(lexicon, F.col("text"))).collect()} == {0.5}
    one = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True))
    assert one.of("x") == pytest.approx(2 / 3)
    assert docs.limit(0).select(toxicity.scored(lexicon, F.col("text"))).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_lexicon_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["toxic"] is not None]
    found = [r["predicted"] for r in held if r["toxic"] == 1]
    false = [r["predicted"] for r in held if r["toxic"] == 0]
    assert np.mean(found) > 0.9 and np.mean(false) < 0.01


def stacked(m):
    r = np.linalg.qr(m, mode="r")
    return np.vstack([r, np.zeros((m.shape[1] - len(r), m.shape[1]))])


def test_qd_solver_against_lapack():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    cases = [rng.normal(size=(500, 48)), rng.normal(size=(500, 48)) @ np.diag(np.geomspace(1, 1e-6, 48)), np.eye(48) @ turn,
             np.diag([1.0] * 24 + [2.0] * 24) @ turn, rng.normal(size=(20, 48)), rng.normal(size=(9, 1)), rng.normal(size=(9, 2)),
             np.diag([3.0, 0.0, 1.0]), np.zeros((4, 3))]
    for _ in range(150):
        d = int(rng.integers(1, 30))
        cases.append(rng.normal(size=(int(rng.integers(1, 90)), d)) * np.exp(rng.normal(size=d) * rng.integers(0, 5)))
    for m in cases:
        values, vectors = whitening.eigen(stacked(m))
        want = np.linalg.svd(stacked(m), compute_uv=False) ** 2
        top = max(want[0], 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * top
        good = values > top * (len(values) * whitening.EPS) ** 1.5
        v = vectors[:, good]
        assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) < 1e-11
        assert np.abs(m.T @ (m @ v) - v * values[good]).max(initial=0) <= 1e-12 * top


def test_qd_values_are_relatively_accurate():
    """Tiny singular values of a bidiagonal matrix come out with all their digits."""
    from fractions import Fraction

    diag, above = np.array([1.0, 1e-4, 1e-9, 2e-12]), np.array([0.5, 3e-5, 1e-9])
    values = whitening.dqds(diag, above)
    product = Fraction(1)
    for x in diag:
        product *= Fraction(float(x)) ** 2  # the determinant is the product of the values
    got = Fraction(1)
    for v in values:
        got *= Fraction(float(v))
    assert abs(float(got / product) - 1) < 1e-13


def brute_whitening(vectors, components=32):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    far = (x * n - sums).astype(object)
    centred = (x * n - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, len(e))
    return n, [int(r) for r in (far * far).sum(axis=1)], centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(900, 40)) @ np.diag(np.geomspace(4, 0.5, 40))
    data[50:80] = data[50]
    rows = [(i if i % 90 else None, v.tolist(), 1.0, i) for i, v in enumerate(data)]
    odd = [(9000, None, 1.0, -1), (9001, [None] * 40, 1.0, -1), (9002, [float("nan")] * 40, 1.0, -1),
           (9003, [float("-inf")] * 40, 1.0, -1), (9004, [1.0] * 39, 1.0, -1), (9005, [], 1.0, -1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n double, component int").repartition(70)
    out = whitening.whitened(df)
    got = out.toPandas()
    n, deviation, white, shares = brute_whitening(data)
    assert len(got) == n * 32 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert {r["component"]: r["explained"] for r in out.collect()} == pytest.approx(dict(enumerate(shares, 1)), rel=1e-9)
    sign = None
    have = defaultdict(list)
    for r in got.itertuples():
        have[(r.vec_id if r.vec_id == r.vec_id else None, r.deviation)].append((r.component, r.whitened))
    for i in range(0, n, 7):
        key = (i if i % 90 else None, deviation[i])
        w = np.array([x for _, x in sorted(have[key])])
        sign = np.sign(w * white[i]) if sign is None else sign
        assert np.abs(w - sign * white[i]).max() < 1e-8
    assert whitening.whitened(df.limit(0)).count() == 0


def test_whitening_of_flat_data(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [
        (1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 7.0, float(-i)]) for i in range(50)], schema)).collect()
    assert {r["explained"] for r in flat if r["component"] > 1} == {0.0} and flat[0]["identity_error"] < 1e-9
    wide = whitening.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1.0, 2.0])], schema)).collect()
    assert len(wide) == 6 and all(np.isfinite(r["whitened"]) for r in wide)


def brute_alignment(a, b, t):
    end_a = np.cumsum([len(t.a_bytes[i]) for i in a]).tolist()
    end_b = np.cumsum([len(t.b_bytes[i]) for i in b]).tolist()
    links = [(a[i], b[end_b.index(x)]) for i, x in enumerate(end_a) if x in set(end_b)]
    groups, i, j = [], 0, 0
    for cut in [x for x in end_a if x in set(end_b)]:
        ga = [k for k in range(i, len(a)) if end_a[k] <= cut]
        gb = [k for k in range(j, len(b)) if end_b[k] <= cut]
        i, j = i + len(ga), j + len(gb)
        groups.append(",".join(str(a[k]) for k in ga) + "|" + ",".join(str(b[k]) for k in gb))
    return links, groups


def brute_documents(texts, path_a, path_b):
    """Plain loops over the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(path_a)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=path_b)
    with open(path_a) as file:
        vocab = {i: s for s, i in json.load(file)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    class T:
        a_bytes = {i: bytes(byte_of[c] for c in s) for i, s in vocab.items() if all(c in byte_of for c in s)}
        b_bytes = {i: bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
                   for i in range(b_tok.get_piece_size()) for p in [b_tok.id_to_piece(i)]}

    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        if b"".join(T.a_bytes[i] for i in a) != raw or b"".join(T.b_bytes[i] for i in b) != raw:
            a, b = [], []
        out.append((a, b, *brute_alignment(a, b, T)))
    count = Counter(p for *_, links, _ in out for p in links)
    best = defaultdict(int)
    for (a, b), n in count.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, links, g in out]


def test_alignment_against_brute_force(spark):
    texts = [None, "", " ", "hi  there", "\n a\tb", "▁x", "é é 　q", "a\0b 😀😀", "</s><s><|endoftext|>", "x ", "ﬁnd z",
             "the house of the river " * 400, "x" * 3000, "the", "the", "Straße über größe", "12 345 6789", prose(1, 500)]
    rows = [(i if i != 5 else None, t, "n", 3) for i, t in enumerate(texts)] + [(13, "the", "n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    want = Counter((r[0], *x) for r, x in zip(rows, brute_documents([r[1] for r in rows], crosstok.JSON, crosstok.PIECES)))
    got = Counter(tuple(r) for r in crosstok.aligned(df).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == want
    assert crosstok.aligned(df.limit(0)).count() == 0


def test_alignment_of_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, brute_documents([r["text"] for r in rows], crosstok.JSON, crosstok.PIECES))}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
           for r in queries.op13_lockstep_alignment(spark, sf_dir).collect()}
    assert got == want


def test_lanes_do_not_change_the_cuts():
    rng = np.random.default_rng(7)
    for n in (1, 2, 50, 3000):
        ends = np.cumsum(rng.integers(1, 4, 2 * n))
        a = np.unique(np.append(rng.choice(ends, n, replace=False), ends[-1]))
        b = np.unique(np.append(rng.choice(ends, n, replace=False), ends[-1]))
        both = np.intersect1d(a, b)
        for lane in (1, 7, 256, 10 ** 6):
            cut_a, cut_b = crosstok.merge(a, b, np.array([0, len(a)]), lane)
            assert (a[cut_a] == both).all() and (b[cut_b] == both).all()
