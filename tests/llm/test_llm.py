"""Operators of the llm subpackage against brute force, with awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelake.llm import (chat, langid, mixing, mtree, neardup, packing, quality, queries, sharding, shingles, spotsigs,
                           urls)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, item int, bands int"


def prose(seed, n, words="the of and house river stone light runs makes over green seven north".split()):
    rng = np.random.default_rng(seed)
    return " ".join(words[i] for i in rng.integers(0, len(words), n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \n ", "one two", "One TWO", base, base, " ".join(near), prose(2, 30), "!!! ???", "x" * 70_000,
             prose(3, 9000), "Straße über größe " * 9, "12 34 56", base.upper(), "a\u00a0b c d e f g", "</s>[INST] \\ <|end|>"]
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], None if i % 4 == 3 else f"s{i % 3}", 0, -1.0, 5, 3, 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_shingles(text):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORD.findall((text or "").translate(up))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {r[0]: brute_shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    low = min(comp[a], comp[b])
                    comp[a] = comp[b] = low
                    again = True
    return comp, sets


def test_shingles_match_words(rows):
    for r in rows:
        assert len(shingles.shingles(r[1])) == len(brute_shingles(r[1]))
    long_word = "y" * 200_000
    assert len(shingles.shingles(f"a {long_word} b")) == 1
    assert (shingles.word_hashes(f"{'ab ' * 50_000}{long_word}")[:2] == shingles.word_hashes("ab ab")).all()
    assert shingles.word_hashes(f"q {long_word}")[1] == shingles.word_hashes(long_word)[0]


def test_near_duplicates_match_brute_force(docs, rows, empty):
    comp, sets = brute_components(rows)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    for i in comp:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_copies_in_many_steps(spark):
    """A chain of slowly changing texts and a family around the threshold."""
    words = prose(5, 120, [f"w{i}" for i in range(400)]).split()
    rows, text = [], list(words)
    for i in range(40):
        text[(7 * i) % 120] = f"n{i}"
        rows.append((i, " ".join(text)))
    for i in range(60):
        rng = np.random.default_rng(100 + i)
        mixed = list(words)
        for at in rng.integers(0, 120, 4):
            mixed[at] = f"m{i}_{at}"
        rows.append((100 + i, " ".join(mixed)))
    comp, _ = brute_components(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp


def test_deduplicated_keeps_columns_and_null_ids(spark, docs, rows):
    more = docs.union(spark.createDataFrame([(None, "x y", *rows[0][2:]), rows[8], rows[8]], SCHEMA))
    out = neardup.deduplicated(more)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    comp, _ = brute_components(rows)
    assert sorted(i for i in ids if i is not None) == sorted(i for i in comp if comp[i] == i) and ids.count(None) == 1


def test_rows_with_one_id_are_one_document(spark):
    a, b = prose(11, 60), prose(12, 60, [f"v{i}" for i in range(90)])
    big = 2 ** 60 + 1
    rows = [(1, min(a, b)), (1, max(a, b)), (2, min(a, b)), (big, max(a, b)), (big, max(a, b)), (3, None), (3, None), (None, a),
            (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.create_map(F.lit("k"), "doc_id"))
    got = sorted(((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(df).collect()))
    assert got == [(0, 0, True)] * 2 + [(1, 1, True)] * 2 + [(2, 2, True)] + [(3, 3, True)] * 2 + [(big, 1, False)] * 2
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.deduplicated(df).collect())
    assert kept == sorted([(0, ""), (0, a), (1, max(a, b)), (2, min(a, b)), (3, "")])


def test_null_ids_keep_large_ids_whole(spark):
    big = 2 ** 60 + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c"), (None, None)], "doc_id long, text string").coalesce(1)
    assert sorted(r["doc_id"] or 0 for r in packing.packed(df).collect()) == [0, 0, big]
    talk = spark.createDataFrame([(big, 0, "user", "x"), (None, 0, "user", "y"), (None, 1, "assistant", "z")],
                                 "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.text_parts(talk)).collect()}
    assert got == {big: (1, 0), None: (2, 1)}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 130)]
    want = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(want)):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want


def test_language(spark, docs, empty, sf_dir):
    model = langid.train(docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i in (0, 1, 2, 9, 13):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert {got[5]["lang_pred"], got[6]["lang_pred"]} <= {"en", "de"} and got[5]["score"] == got[6]["score"]
    none = langid.train(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    one = langid.train(docs.filter("lang = 'en'"), F.lit(True))
    assert langid.identify(docs.filter("doc_id = 5"), one).first()["score"] == 1.0
    out = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet")
                                                      .select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    for r in out:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


def test_slices_do_not_change_the_prediction_much():
    text = prose(4, 300_000)
    assert len(langid.subword_ids(text, 12)) > len(text)


def test_quality(spark, docs, empty, sf_dir):
    labels = spark.createDataFrame([(5, 1), (6, 1), (8, 0), (8, 1), (9, 0), (None, 1), (7, None)], "doc_id long, quality int")
    trees = quality.train(docs, labels, F.lit(True))
    got = {r[0]: r[1] for r in docs.select("doc_id", quality.scored(trees, F.col("text"))).collect()}
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got.values())
    nothing = quality.train(empty, labels, F.lit(True))
    assert docs.select(quality.scored(nothing, F.col("text"))).distinct().collect()[0][0] == 0.5
    out = queries.op8_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    out = out.filter("held_out").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in out]) > 0.9


def test_trees_walk_as_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] > 0).astype(float)
    trees = quality.boost(x, y, trees=10, depth=3)
    for row, score in zip(x[:50], trees.score(x[:50])):
        total = trees.start
        for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > limit[at])
            total += leaf[at - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.9


def test_packing(docs, rows, empty):
    got = packing.packed(docs, window=256).collect()
    tokens = {i: packing._plain(packing.JSON).encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in rows}
    pieces = defaultdict(dict)
    windows = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["doc_tokens"] == len(tokens[r["doc_id"]])
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, found in pieces.items():
        assert [x for at in sorted(found) for x in found[at]] == tokens[i]
    assert set(pieces) == set(tokens)
    last = max(windows)
    for number, parts in windows.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 256 or number == last
    assert packing.packed(empty).count() == 0


def test_fast_ids_equal_the_tokenizers_file():
    rng = np.random.default_rng(3)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x600), range(0x4E00, 0x4F00), [9, 10, 13, 32, 0xA0, 0x2003],
             range(0x1F600, 0x1F640)]
    for _ in range(300):
        pool = [c for k in rng.choice(len(pools), 2) for c in pools[k]]
        text = "".join(chr(pool[i]) for i in rng.integers(0, len(pool), 60))
        assert packing.encode(text) == packing._plain(packing.JSON).encode(text, add_special_tokens=False).ids
    for text in ("a <|endoftext|> b", " " * 5000, "\n" * 3000 + "x", "ab" * 20_000):
        assert packing.encode(text) == packing._plain(packing.JSON).encode(text, add_special_tokens=False).ids


def test_sharding(spark, docs, rows, empty):
    hot = spark.createDataFrame([(1000 + i, "same words here", *rows[0][2:]) for i in range(600)], SCHEMA)
    more = [(5000 + i, prose(i, 20 + i % 50), *rows[0][2:]) for i in range(400)]
    both = docs.union(hot).union(spark.createDataFrame(more, SCHEMA)).filter("doc_id NOT IN (10, 11)")
    got = sharding.sharded(both).toPandas()
    text = {r[0]: r[1] or "" for r in rows + more} | {1000 + i: "same words here" for i in range(600)}
    for r in got.itertuples():
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.05 * sizes.mean()
    assert got.groupby("shard").size().std() < 0.2 * len(got) / 8
    same = got[got.doc_id.isin([5, 6])]
    assert same["shard"].nunique() == 1
    assert got.sort_values("doc_id").reset_index(drop=True).equals(
        sharding.sharded(both.repartition(5)).toPandas().sort_values("doc_id").reset_index(drop=True))
    assert sharding.sharded(empty).count() == 0


def water(sizes, weights=(3, 1, 2), mass=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, mass * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, docs, rows, empty):
    more = [(100 + i, prose(i, 5 + (i * 37) % 90), "en", None if i % 7 == 0 else f"s{i % 5}", *rows[0][4:])
            for i in range(900)]
    both = docs.union(spark.createDataFrame(more, SCHEMA))
    got = mixing.mixed(both).toPandas()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows + more}
    source = {r[0]: r[3] for r in rows + more}
    totals = defaultdict(int)
    for i, n in size.items():
        totals[source[i]] += n
    target = water(totals)
    taken = defaultdict(int)
    for r in got.itertuples():
        s = source[r.doc_id]
        assert (r.size, r.source_size, r.taken) == (size[r.doc_id], totals[s], r.copies * r.size)
        assert r.target == pytest.approx(target[s]) and 0 <= r.copies <= 2
        taken[s] += r.taken
    for s in totals:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 20
    again = mixing.mixed(both.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    rates = got[(got["size"] > 0) & (got.rate < 2)]
    for s, part in rates.groupby(rates.doc_id.map(lambda i: source[i] or "-")):
        ratio = np.log(part.rate) / part["size"]  # one exponential tilt for each source
        assert ratio.std() < 1e-6 + 1e-6 * abs(ratio.mean())
    copies = mixing.repeated(both)
    assert copies.columns == docs.columns
    n = {r["doc_id"]: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert n == {r.doc_id: r.copies for r in got.itertuples() if r.copies}
    assert mixing.mixed(empty).count() == 0 and mixing.repeated(empty).count() == 0


def brute_spots(text, chain=2):
    anchors = set(spotsigs.ANCHORS.split())
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    content = [(i, w) for i, w in enumerate(words) if w not in anchors]
    found = set()
    for i, w in enumerate(words):
        if w in anchors:
            after = [c for j, c in content if j > i][:chain]
            if len(after) == chain:
                found.add((w, *after))
    return found


def test_spot_signatures(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in spotsigs.fingerprinted(docs).collect()}
    order = sorted(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    prints = defaultdict(set)
    for at, i in enumerate(order):
        after = text[order[(at + 1) % len(order)]]
        cut = len(text[i]) // 4
        edited = text[i][:len(text[i]) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited"]) == (len(text[i]), edited)
        spots, other = brute_spots(text[i]), brute_spots(edited)
        if spots:
            assert len(got[i]["fingerprint"]) == 10 * len(spots)
        if spots and other:
            assert got[i]["near_edited"] == pytest.approx(len(spots & other) / len(spots | other))
        prints[text[i]].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and got[0]["fingerprint"] == ""
    assert got[0]["near_edited"] == 1.0 and got[5]["near_next"] == 1.0
    assert spotsigs.fingerprinted(empty).count() == 0
    assert spotsigs.fingerprinted(docs.filter("doc_id = 5")).first()["near_next"] == 1.0
    pairs, member = spotsigs.near_pairs(docs, 0.6)
    reps = {r["doc_id"]: r["rep"] for r in member.collect()}
    want = {(a, b) for a in set(reps.values()) for b in set(reps.values()) if a < b
            and brute_spots(text[a]) and brute_spots(text[b])
            and len(brute_spots(text[a]) & brute_spots(text[b])) >= 0.6 * len(brute_spots(text[a]) | brute_spots(text[b]))}
    assert want <= {(r["a"], r["b"]) for r in pairs.collect()} and reps[5] == reps[6]


def test_spot_signatures_stay_native(docs):
    plan = spotsigs.fingerprinted(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_mtree(spark):
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(700, 12)).round(3)
    vec[100:160] = vec[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vec)]
    rows += [(800, None), (900, [float("nan")] * 12), (1000, [None] * 12), (1100, [float("inf")] * 12), rows[300], (1200, [1.0, 2.0])]
    data = mtree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = mtree.top_k(data, data.filter("vec_id % 100 = 0"), cells=8, tree_rows=50).collect()
    q = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in rows[:700]}
    for i in range(0, 700, 100):
        want = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:10]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want
    none = data.filter("vec_id < 0")
    assert mtree.top_k(none, none).count() == 0
    big = np.array([[2 ** 40, 3], [2 ** 41, -1]], np.int64)
    assert mtree.products(big, np.array([2 ** 40, 1], np.int64)).tolist() == [2 ** 80 + 3, 2 ** 81 - 1]


class Counted(tuple):
    """A leaf page that notes how often it is opened."""

    def __new__(cls, page, seen):
        self = super().__new__(cls, page)
        self.seen = seen
        return self

    def __getitem__(self, at):
        if at == 1:
            self.seen.append(len(super().__getitem__(2)))
        return super().__getitem__(at)


def test_mtree_skips_distances():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 3000
    x = np.concatenate([c + rng.normal(size=(100, 8)) * 30 for c in centres]).astype(np.int64)
    tree = mtree.MTree(x, [np.array([i]) for i in range(len(x))])
    seen = []
    far = mtree.MTree._far
    tree._far = lambda points, at: (seen.append(len(points)), far(points, at))[1]
    tree.pages = [Counted(p, seen) if p[0] else p for p in tree.pages]
    got = tree.search(x[7], 5)
    assert got == sorted(((int(x[7] @ v), i) for i, v in enumerate(x)), key=lambda t: (-t[0], t[1]))[:5]
    assert sum(seen) < 0.5 * len(x)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", said), (1, 0, "user", None), (2, None, None, "a\\n<|end|>\n<|turn|>x\n"), (2, 3, "as\nsi", ""),
            (3, 0, "assistant", "<<SYS>>\\<|"), (3, 0, "assistant", "<<SYS>>\\<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.text_parts(df)).collect()}
    for conv in (1, 2, 3):
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.text_parts(df.limit(0))).count() == 0
    for text in ("", "\\", "\\n", "<|", "<\\|", "[INST][/INST]<s></s>", "<</SYS>>"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_parts(spark):
    part = "array<" + chat.PART + ">"
    t = dict.fromkeys(("text", "uri", "width", "height", "seconds", "pages"))
    parts = [t | {"kind": "text", "text": "see "}, t | {"kind": "image", "uri": "i.png", "width": 57, "height": 28},
             t | {"kind": "audio", "uri": "a.wav", "seconds": 2.0}, t | {"kind": "document", "pages": 3}, t | {"kind": "odd"}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               f"conv_id long, turn long, role string, parts {part}")
    first = chat.formatted(df).orderBy("turn").first()
    assert first["rendered"] == "<|turn|>user\nsee <|image:0|><|audio:1|><|document:2|><|document:3|><|end|>\n"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in first["attachments"]] == [
        ("image", "i.png", 3), ("audio", "a.wav", 25), ("document", None, 3072), ("document", None, 1024)]
    assert chat.digests(df).first()["attachments"] == 4


def test_urls(spark):
    pages = [(1, "http://A.Example.ORG/en/17?x#y"), (2, "https://notexample.org/es/"), (3, "x://com/de/1"), (4, None),
             (5, "no scheme"), (6, "http://b.com/fr/?utm_source=a&z=1"), (7, "http://www.bad.net/p/"), (8, "http://bad.net/p#f"),
             (9, "http://org"), (9, "http://org"), (10, "http://sub.example.org/es/q")]
    listed = spark.createDataFrame([("https://bad.net/p",), (None,), ("https://bad.net/p",), ("http://b.com/fr?z=1",)], "url string")
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(df, listed).collect()}
    assert got == {1: ("a.example.org", "/en/17", "example.org/en/1", "block"), 2: ("notexample.org", "/es/", "org/", "allow"),
                   3: ("com", "/de/1", "com/de/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
                   6: ("b.com", "/fr/", "com/fr/", "allow"), 7: ("www.bad.net", "/p/", None, "block"),
                   8: ("bad.net", "/p", None, "block"), 9: ("org", "", None, "allow"),
                   10: ("sub.example.org", "/es/q", "example.org/es/", "block")}
    assert urls.judged(df, listed).count() == len(pages) and urls.judged(df, listed.limit(0)).count() == len(pages)


def test_filter_lets_few_others_pass(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    rows, blocks = urls.bloom(keys, "key")
    probes = spark.range(4000, 24000).select(F.concat(F.lit("k"), "id").alias("key")).withColumn(
        "block", urls._block(F.col("key"), blocks)).join(rows, "block", "left")
    hit = F.lit(True)
    for i in range(urls.WORDS):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(urls._bit(F.col("key"), i)) != 0)
    assert probes.filter(hit).count() < 600


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.count()
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = cp.stored(after, "test")
        assert 0 < docs.count() <= 2 * seen
    total = sum(len(packing.encode(r["text"])) + 1 for r in docs.select("text").collect())
    out = cp.STAGES[-1][1](spark, docs, sf_dir).agg(F.sum("length")).first()[0]
    assert out == total
