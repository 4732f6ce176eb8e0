"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text (shares of character classes, word and line repetition, word shape) are binned to
histograms, and depth-wise trees are boosted on the logistic loss in numpy.  The trees are complete binary trees stored
as flat arrays, so a batch of documents walks all of them with a few vectorised steps for each level.

``boost`` fits on rows in memory.  ``boost_spread`` fits on rows that stay in their partitions: a level of a tree is one job,
which adds up the histograms of all rows.

Defined cases: NULL and empty texts have all-zero statistics and get the score of those.  Without labelled rows, or with
one label only, the score is the smoothed share of good labels (0.5 without any).  A document with several labels takes
their rounded mean; NULL labels do not count.  Repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import add, eq

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.sources.workspace import stored

FEATURES = ("log_chars", "log_words", "letters", "upper", "digits", "spaces", "newlines", "symbols", "bars", "marks",
            "stops", "high_bytes", "word_length", "distinct_words", "top_word", "repeated_next", "short_words",
            "distinct_lines", "words_per_line", "top_pair")

FOLDS = 3
BLOCK_ROWS = 1 << 16

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*^~<>=+{}[]\\@_/", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower = int(count[_UPPER].sum()), int(count[_LOWER].sum())
    high = int(count[128:].sum())
    words = text.split()
    n_words = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    n_lines = max(len(lines), 1)
    words_of = Counter(words)
    pairs = Counter(zip(words, words[1:])) if len(words) > 1 else Counter()
    return [
        np.log1p(n), np.log1p(len(words)), (upper + lower + high) / n, upper / max(upper + lower, 1),
        count[_DIGIT].sum() / n, count[[9, 10, 11, 12, 13, 32]].sum() / n, count[10] / n, count[_SYMBOL].sum() / n,
        count[124] / n, (count[33] + count[63]) / n, (count[46] + count[44]) / n, high / n,
        sum(map(len, words)) / n_words, len(words_of) / n_words, max(words_of.values(), default=0) / n_words,
        sum(map(eq, words, words[1:])) / n_words, sum(len(w) < 4 for w in words) / n_words,
        len(set(lines)) / n_lines, np.log1p(n_words / n_lines), max(pairs.values(), default=0) / n_words,
    ]


def table(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """``feature``/``limit``: a row for each tree, inner nodes in level order; ``leaf``: a row for each tree."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        inner = (1 << depth) - 1
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
          ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost ``trees`` complete trees; a node with no useful split sends every row to the left."""
    share = (y.sum() + 1) / (len(y) + 2)
    none = Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), none.start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, limits, values = [], [], []
    n_edges = np.array([len(e) for e in edges])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            got = histograms(binned, at - first, grad, hess, width, bins)
            feature[first:first + width], cut = splits(*got, n_edges, ridge, least)
            for k in np.flatnonzero(cut >= 0):
                limit[first + k] = edges[feature[first + k]][cut[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        leaf_of = at - inner
        g, h = np.bincount(leaf_of, grad, leaves), np.bincount(leaf_of, hess, leaves)
        leaf = -rate * g / (h + ridge)
        raw += leaf[leaf_of]
        features.append(feature), limits.append(limit), values.append(leaf)
    return Trees(np.array(features), np.array(limits), np.array(values), none.start)


def histograms(binned: np.ndarray, node: np.ndarray, grad: np.ndarray, hess: np.ndarray, width: int, bins: int) -> np.ndarray:
    """Sums of gradients and of second derivatives by node, feature and bin."""
    keys = [node * bins + binned[:, j] for j in range(binned.shape[1])]
    return np.stack([np.stack([np.bincount(key, of, width * bins).reshape(width, bins) for key in keys], axis=1)
                     for of in (grad, hess)])


def splits(g: np.ndarray, h: np.ndarray, n_edges: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The feature and the last bin on the left that help each node most; the bin is -1 where no cut helps."""
    width, _, bins = g.shape
    g, h = g.cumsum(axis=2), h.cumsum(axis=2)
    gt, ht = g[..., -1:], h[..., -1:]
    gain = g ** 2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt ** 2 / (ht + ridge)
    gain[(h < least / 4) | (ht - h < least / 4)] = -1
    gain[:, np.arange(bins) >= n_edges[:, None]] = -1
    flat = gain.reshape(width, -1)
    best = flat.argmax(axis=1)
    helps = flat[np.arange(width), best] > 1e-9
    return np.where(helps, best // bins, 0), np.where(helps, best % bins, -1)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> DataFrame:
    """Statistics ``x``, ``label`` and ``fold`` of every labelled row; equal rows are one, equal texts share a fold.

    Statistics are made before the join, so that texts are not shuffled.
    """

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(table(texts)))

    marked = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    rows = docs.filter(usable & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"),
                                                                    measured("text").alias("x"))
    once = rows.join(marked, "doc_id").groupBy("doc_id", "t").agg(F.first("x").alias("x"), F.first("label").alias("label"))
    return once.select("x", "label", F.pmod("t", F.lit(FOLDS)).cast("int").alias("fold"))


def boost_spread(points: DataFrame, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0,
                 least: float = 5.0) -> tuple[Trees, RDD]:
    """Boost as ``boost`` does on all rows of ``points``, which are read several times.

    Returns the trees, and (label, score) arrays in which each row's score comes from trees that its fold has no part in:
    those of each fold grow in the same jobs.  Rows are kept as one byte a feature and one number a model.  Bins end at
    quantiles of all rows, within a ten-thousandth of them.
    """
    n_models, inner = FOLDS + 1, (1 << depth) - 1
    tally = np.zeros((FOLDS, 2))
    for r in points.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect():
        tally[r["fold"]] = r["n"], r["good"]
    n, good = np.concatenate([tally.sum(axis=0) - tally, tally.sum(axis=0, keepdims=True)]).T
    share = (good + 1) / (n + 2)
    start, mixed = np.log(share / (1 - share)), (good > 0) & (good < n)
    cuts = points.agg(*[F.percentile_approx(F.col("x")[j], [i / bins for i in range(1, bins)], 10_000)
                        for j in range(len(FEATURES))]).first()
    edges = [np.unique(np.array(c or [], np.float64)) for c in cuts]
    n_edges = np.array([len(e) for e in edges])

    def binned(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
                yield pd.DataFrame({"codes": [codes.astype(np.uint8).tobytes()], "fold": [pdf["fold"].astype("u1").to_numpy().tobytes()],
                                    "label": [pdf["label"].astype("u1").to_numpy().tobytes()]})

    def block(rows):
        codes, label, fold = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), np.uint8) for k in ("codes", "label", "fold"))
        return codes.reshape(-1, len(FEATURES)), label.astype(float), fold, np.repeat(start[:, None], len(label), axis=1)

    def blocks(rows):
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r["label"])
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    def walked(codes, feature, cut, levels):
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            at = 2 * at + 1 + (codes[rows, feature[at]] > cut[at])
        return at

    def grown(feature, cut, leaf):
        def run(got):
            codes, label, fold, raw = got
            step = [leaf[m][walked(codes, feature[m], cut[m], depth) - inner] for m in range(n_models)]
            return codes, label, fold, raw + np.stack(step)
        return run

    def summed(feature, cut, level):
        first, width = (1 << level) - 1, 1 << level

        def run(parts):
            total = np.zeros((n_models, 2, width, len(FEATURES), bins))
            for codes, label, fold, raw in parts:
                for m in np.flatnonzero(mixed):
                    use = fold != m
                    p = 1 / (1 + np.exp(-raw[m, use]))
                    node = walked(codes[use], feature[m], cut[m], level) - first
                    total[m] += histograms(codes[use], node, p - label[use], p * (1 - p), width, bins)
            yield total
        return run

    total_rows = int(n[-1])
    parts = min(-(-total_rows // 10_000), max(points.sparkSession.sparkContext.defaultParallelism, -(-total_rows // 500_000)))
    rows = points.coalesce(max(parts, 1)).mapInPandas(binned, "codes binary, label binary, fold binary").rdd
    state = rows.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)
    features, limits, values, before = [], [], [], None
    for _ in range(trees if mixed.any() else 0):
        feature, cut = np.zeros((n_models, inner), np.int64), np.full((n_models, inner), 255)
        leaf = np.zeros((n_models, inner + 1))
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            total = state.mapPartitions(summed(feature.copy(), cut.copy(), level)).treeReduce(add)
            if before is not None:
                before.unpersist()
                before = None
            for m in np.flatnonzero(mixed):
                g, h = total[m]
                feature[m, first:first + width], at = splits(g, h, n_edges, ridge, least)
                cut[m, first:first + width] = np.where(at < 0, 255, at)
                if level == depth - 1:
                    for k in range(width):
                        left = np.arange(bins) <= cut[m, first + k]
                        for side, of in enumerate((left, ~left)):
                            j = feature[m, first + k]
                            leaf[m, 2 * k + side] = -rate * g[k, j, of].sum() / (h[k, j, of].sum() + ridge)
        before, state = state, state.map(grown(feature, cut, leaf)).persist(StorageLevel.MEMORY_AND_DISK)
        features.append(feature[-1]), values.append(leaf[-1])
        limits.append(np.array([edges[j][c] if c < 255 else np.inf for j, c in zip(feature[-1], cut[-1])]))
    scores = state.map(lambda got: (got[1], 1 / (1 + np.exp(-got[3][got[2], np.arange(len(got[2]))]))))
    if not mixed[-1]:
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), float(start[-1])), scores
    return Trees(np.array(features), np.array(limits), np.array(values), float(start[-1])), scores


def sampled(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
            rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` labelled rows, those whose hashes of id and text are smallest; equal rows are one.

    The ids are chosen first, then the rows again, as an id may stand on many rows; statistics are made in tasks, and only
    those reach the driver.
    """
    marked = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg((F.avg(label) >= 0.5).cast("int").alias("_label")))
    wanted = marked.join(docs.filter(usable).select("doc_id"), "doc_id", "left_semi")
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.filter(usable).select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    once = (found.groupBy(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
            .agg(F.min("text").alias("text"), F.min("_label").alias("_label")))

    def measured(parts):
        for pdf in parts:
            yield pd.DataFrame({"h": pdf["h"], "t": pdf["t"], "label": pdf["_label"], "x": list(table(pdf["text"]))})

    got = once.mapInPandas(measured, "h long, t long, label int, x array<double>").orderBy("h", "t").limit(rows).collect()
    got.sort(key=lambda r: (r["h"], r["t"]))
    x = np.array([r["x"] for r in got], np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r["label"] for r in got], np.float64)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = 6000) -> Trees:
    """Fit on the rows of :func:`sampled`."""
    return boost(*sampled(docs, labels, usable, label, rows))


def train_with_limit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
                     most_rejected: float = 0.001) -> tuple[Trees, float]:
    """The trees, fitted on all labelled rows, and the score below which a document is rejected.

    The limit is one half, or less where that would cost more than ``most_rejected`` of the good rows, each judged by trees
    that were fitted on the other folds.
    """
    trees, scores = boost_spread(stored(labelled(docs, labels, usable, label), "quality-points"))
    good = scores.flatMap(lambda got: [(float(s),) for s in got[1][got[0] == 1]])
    lowest = docs.sparkSession.createDataFrame(good, "score double").agg(F.percentile_approx("score", most_rejected, 100_000))
    limit = lowest.first()[0]
    return trees, 0.0 if limit is None else min(0.5, limit)


def scored(trees: Trees, text: Column) -> Column:
    """Score of each text, 0 to 1; higher means that label 1 is likelier."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(table(texts)), dtype="float64")

    return run(text)
