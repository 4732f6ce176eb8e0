"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding makes disguises meet their word: compatibility forms and accents are undone, letters of other scripts that look Latin
become Latin, digits and signs that stand for letters become letters inside words that have a letter, everything else
separates words.  One automaton finds lexicon entries (word stems and whole words, at the start of a word) and exception
phrases; a hit inside an exception phrase does not count.  The weights of the hits are divided by the number of words, and a
logistic curve turns that rate into a score.

The lexicon is learned from a bounded sample of labelled rows.  Stems are ranked by how much likelier they are in documents
marked toxic (likelihood ratio); entries are taken one after the other, and documents that an entry explains count less
from then on; near copies are learned from once.  So the other words of much-copied documents are not taken for toxic
ones.  A stem is only as short as its word family needs: a longer one with the same hits is preferred.  Words that begin like
an entry but are at home in clean documents become exceptions.  The curve is fitted on rows that the lexicon was not learned
from.

Defined cases: NULL and empty texts, and texts without a word, have rate 0 and the score of that rate.  Without labelled
rows, or with one label only, every score is the smoothed share of toxic labels (0.5 without any).  A document with several
labels takes their rounded mean, NULL labels do not count; equal texts are learned from once.  Rows of equal text score
alike.  Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelake.llm.shingles import shingles
from platelake.sources.workspace import stored

# Letters that look like a Latin one, and signs that stand for a letter inside a word.
LOOKALIKE = {"а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
             "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b",
             "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
             "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "օ": "o", "ѵ": "v", "ո": "n", "ս": "u", "ц": "u"}
DIGIT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Phrases in which a word of the lexicon is meant well.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown")

STEM = range(3, 13)
ALL = ""  # counts all words
_DIGIT = str.maketrans(DIGIT)
_MARKED = re.compile(r"[^\W_]*(?:[@$!0-9]+[^\W_]*)+")
_WORD = re.compile(r"[^\W\d_]+")


class _Fold(dict):
    """Translation table filled on demand: marks go, look-alikes become Latin letters."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        out = "".join(LOOKALIKE.get(x, x) for x in base)
        self[code] = out if unicodedata.category(c) != "Cf" else ""
        return self[code]


_FOLD = _Fold()


def _letters(match: re.Match) -> str:
    word = match[0]
    if not any(c.isalpha() for c in word):
        return " "
    return word.rstrip("!$@").translate(_DIGIT) + " " * (word[-1] in "!$@")


def folded_words(text: str | None) -> list[str]:
    """The words of a text, folded."""
    if not text:
        return []
    flat = text.translate(_FOLD)
    if _MARKED.search(flat):
        flat = _MARKED.sub(_letters, flat)
    return _WORD.findall(flat)


@lru_cache(maxsize=4)
def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for phrase in exceptions:
        auto.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
    for word, weight in entries:
        auto.add_word(f" {word}", (len(word) + 1, weight, False))
    auto.make_automaton()
    return auto


@dataclass(frozen=True)
class Lexicon:
    """``entries``: stem, or whole word with a space behind it, and weight; ``exceptions``: folded words or phrases; ``slope``
    and ``start`` of the logistic curve over the logarithm of the rate."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    slope: float
    start: float

    def hits(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights found in the text, and its number of words."""
        words = folded_words(text)
        if not words or not self.entries:
            return 0.0, len(words)
        auto = _automaton(self.entries, self.exceptions)
        flat = " " + " ".join(words) + " "
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight, exception) in auto.iter(flat):
            start = end - size + 1
            if exception:
                free.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for lo, hi in free:
            for start in range(lo, hi):
                found.pop(start, None)
        return sum(found.values()), len(words)

    def score(self, rate: float) -> float:
        return float(1 / (1 + np.exp(-(self.start + self.slope * np.log(rate + FLOOR)))))

    def of(self, text: str | None) -> float:
        weight, words = self.hits(text)
        return self.score(weight / (words + SPARE))


# A rate counts from about one weak hit in a thousand words; very short texts count as if they had some more words.
FLOOR, SPARE = 1e-3, 10


# A document counts a stem this often at most, so that one that repeats itself says little about others.
MOST_IN_ONE = 8


def ratio(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Likelihood ratio statistic of a stem's share of the words of toxic documents, 0 where it is not above that of clean ones."""
    both, total = pos + neg, n_pos + n_neg
    p, q, r = pos / max(n_pos, 1), neg / max(n_neg, 1), both / total

    def part(x, n, rate):
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return x * np.log(rate) + (n - x) * np.log(1 - rate)

    g = 2 * (part(pos, n_pos, p) + part(neg, n_neg, q) - part(pos, n_pos, r) - part(neg, n_neg, r))
    return np.where(p > q, g, 0.0)


def stems(words: Counter) -> Counter:
    """How often each stem begins a word, and each short word (with a space behind) is one; MOST_IN_ONE at most."""
    out: Counter = Counter()
    for w, n in words.items():
        for k in STEM:
            if k <= len(w):
                out[w[:k]] += n
        if len(w) <= STEM[-1]:
            out[w + " "] += n
    return Counter({s: min(n, MOST_IN_ONE) for s, n in out.items()})


@F.pandas_udf(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
def sketch(texts: pd.Series) -> pd.DataFrame:
    """Least and greatest hash of a text's five-word shingles; near copies share one of them as a rule."""
    sets = [shingles(t).view(np.int64) for t in texts]
    return pd.DataFrame([(int(s[0]), int(s[-1])) if len(s) else (0, 0) for s in sets], columns=["lo", "hi"])


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, label: str, rows: int) -> DataFrame:
    """``rows`` texts of each label at most, each text once: label, text, and a fold number from the text's hash.

    The ids are chosen first and their number is bounded; then equal texts are merged and the rows bounded again, as an id may
    stand on many rows.
    """
    marked = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg((F.avg(label) >= 0.5).cast("int").alias("label")))
    ids = docs.filter(usable).select("doc_id").join(marked, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [ids.filter(F.col("label") == k).orderBy(*order).limit(rows) for k in (1, 0)]
    texts = (docs.filter(usable & F.col("text").isNotNull()).select("doc_id", "text")
             .join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("label", "text"))
    # Near copies would make their common words look typical: one text for each least and each greatest shingle hash.
    once = stored(texts.withColumn("h", F.xxhash64("text")).groupBy("h", "label").agg(F.min("text").alias("text"))
                  .withColumn("s", sketch("text")), "toxicity-texts")
    kept = once.select("label", "h", "s.lo", "s.hi")
    kept = kept.groupBy("label", "lo").agg(F.min("h").alias("h"), F.min_by("hi", "h").alias("hi"))
    kept = kept.groupBy("label", "hi").agg(F.min("h").alias("h"))
    kept = [kept.filter(F.col("label") == k).orderBy("h").limit(rows).select("label", "h") for k in (1, 0)]
    return (once.join(F.broadcast(kept[0].unionByName(kept[1])), ["label", "h"], "left_semi")
            .select("label", "text", F.pmod(F.shiftright("h", 3), F.lit(5)).alias("fold")))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = 4000,
          candidates: int = 4000, least: float = 25.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn from at most ``rows`` documents of each label, those whose hashed id is smallest.

    Every fifth text is kept for the curve.  Stem counts are made in tasks and added by Spark; the driver gets the
    ``candidates`` best stems and, for each sampled text, the words that begin with one of them.
    """
    sample = stored(labelled(docs, labels, usable, label, rows), "toxicity-sample")
    sizes = Counter()
    for r in sample.groupBy("label", (F.col("fold") > 0).alias("learned")).agg(F.count("*").alias("n")).collect():
        sizes[r["label"], r["learned"]] = r["n"]
    n_pos, n_neg = (sizes[k, True] + sizes[k, False] for k in (1, 0))
    if not n_pos or not n_neg:
        return Lexicon((), (), 0.0, float(np.log((n_pos + 1) / (n_neg + 1))))
    learn = sample.filter("fold > 0") if sizes[1, True] and sizes[0, True] else sample

    def counted(parts):
        for pdf in parts:
            got = {1: Counter(), 0: Counter()}
            for mark, text in zip(pdf["label"], pdf["text"]):
                words = Counter(folded_words(text))
                got[mark].update(stems(words))
                got[mark][ALL] += words.total()
            stem = list(got[1] | got[0])
            yield pd.DataFrame({"stem": stem, "pos": [got[1][s] for s in stem], "neg": [got[0][s] for s in stem]})

    stats = stored(learn.select("label", "text").mapInPandas(counted, "stem string, pos long, neg long")
                   .groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxicity-stems")
    total = stats.filter(F.col("stem") == ALL).first()

    @F.pandas_udf("double")
    def rank(pos: pd.Series, neg: pd.Series) -> pd.Series:
        return pd.Series(ratio(pos.to_numpy(float), neg.to_numpy(float), total["pos"], total["neg"]))

    best = (stats.filter((F.col("stem") != ALL) & (F.col("pos") >= 3)).withColumn("g", rank("pos", "neg"))
            .filter(F.col("g") >= least).orderBy(F.desc("g"), "stem").limit(candidates).collect())
    known = {r["stem"] for r in best}

    def found(parts):
        for pdf in parts:
            rows_ = []
            for mark, fold, text in zip(pdf["label"], pdf["fold"], pdf["text"]):
                words = Counter(folded_words(text))
                some = {w: n for w, n in words.items() if w + " " in known or any(w[:k] in known for k in STEM)}
                rows_.append((mark, fold, words.total(), list(some), list(some.values())))
            yield pd.DataFrame(rows_, columns=["label", "fold", "words", "word", "n"])

    got = sample.mapInPandas(found, "label int, fold int, words long, word array<string>, n array<long>").collect()
    got.sort(key=lambda r: (r["label"], r["fold"], r["words"], list(r["word"])))
    entries, plain = choose([r for r in got if r["fold"]] or got, known, least)
    free = tuple(dict.fromkeys([" ".join(folded_words(p)) for p in exceptions] + plain))
    lexicon = Lexicon(tuple(entries), free, 0.0, 0.0)
    curve = [r for r in got if not r["fold"]] or got
    rates = [_rate(r, lexicon) for r in curve]
    slope, start = logistic(np.log(np.array(rates) + FLOOR), np.array([r["label"] for r in curve], float))
    return Lexicon(lexicon.entries, lexicon.exceptions, slope, start)


def _rate(row, lexicon: Lexicon) -> float:
    """The rate of a sampled text from its kept words; phrases of several words play no part in it."""
    weights, free = dict(lexicon.entries), set(lexicon.exceptions)
    total = 0.0
    for w, n in zip(row["word"], row["n"]):
        if w not in free:
            total += n * max([weights.get(w + " ", 0.0), *(weights.get(w[:k], 0.0) for k in STEM)])
    return total / (row["words"] + SPARE)


def choose(rows: list, known: set[str], least: float, most_weight: float = 8.0) -> tuple[list[tuple[str, float]], list[str]]:
    """Entries with weights, and words that begin like an entry but are clean.

    A hit in a toxic document counts 1, and 1 / (1 + entries) once entries were found in it.
    """
    names = sorted(known)
    code = {s: i for i, s in enumerate(names)}
    label = np.array([r["label"] for r in rows])
    n_pos, n_neg = (float(sum(r["words"] for r in rows if r["label"] == k)) for k in (1, 0))
    cells: Counter = Counter()
    for i, r in enumerate(rows):
        for w, n in zip(r["word"], r["n"]):
            for s in _of(w, known):
                cells[i, code[s]] += n
    at = np.array(list(cells), np.int64).reshape(-1, 2)
    owner, stem = at[:, 0], at[:, 1]
    times_in = np.minimum(np.array(list(cells.values()), float), MOST_IN_ONE)
    neg = np.bincount(stem, times_in * (label[owner] == 0), len(names))
    in_pos = label[owner] == 1
    owner, stem, times_in = owner[in_pos], stem[in_pos], times_in[in_pos]
    by_stem = np.argsort(stem, kind="stable")
    docs_of = np.split(owner[by_stem], np.searchsorted(stem[by_stem], np.arange(1, len(names))))
    raw = np.bincount(stem, times_in, len(names))
    hits = np.zeros(len(rows))
    chosen: list[int] = []
    closed = np.zeros(len(names), bool)
    while len(names):
        pos = np.bincount(stem, times_in / (1 + hits[owner]), len(names))
        g = np.where(closed, 0.0, ratio(pos, neg, n_pos, n_neg))
        k = int(g.argmax())
        if g[k] < least:
            break
        # The longest stem that has nearly all hits of this one, seen from the start of the word.
        same = [j for j, s in enumerate(names) if s.startswith(names[k]) and raw[j] >= 0.97 * raw[k]]
        k = max(same, key=lambda j: (len(names[j].rstrip()), names[j].endswith(" "), names[j]))
        chosen.append(k)
        hits[docs_of[k]] += 1
        for j, s in enumerate(names):
            closed[j] |= s.startswith(names[k]) or names[k].startswith(s)
    # Weights compare how often a word of all words is one of the entry's, in toxic and in clean documents.
    place = {names[k]: i for i, k in enumerate(chosen)}
    times, words = np.zeros((2, len(chosen))), np.zeros(2)
    for r in rows:
        words[r["label"]] += r["words"]
        for w, n in zip(r["word"], r["n"]):
            for s in _of(w, place):
                times[r["label"], place[s]] += n
    share = (times + 0.5) / (words[:, None] + 1)
    weight = np.clip(np.log(share[1] / share[0]), 0.0, most_weight)
    entries = sorted((s, float(weight[i])) for s, i in place.items() if weight[i] > 0)
    picked = {s for s, _ in entries}
    seen: dict[str, list[int]] = {}
    for r in rows:
        for w in r["word"]:
            if any(s in picked for s in _of(w, picked)):
                seen.setdefault(w, [0, 0])[r["label"]] += 1
    clean = [w for w, (no, yes) in sorted(seen.items()) if no >= 2 and yes * n_neg <= no * n_pos]
    return entries, clean


def _of(word: str, known: set[str]) -> list[str]:
    return [s for s in (word + " ", *(word[:k] for k in STEM if k <= len(word))) if s in known]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope (not below 0) and start of the logistic curve, the slope held back by a ridge; Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    centre = x.mean()
    m = np.stack([x - centre, np.ones(len(x))], axis=1)
    b = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -40, 40)))
        grad = m.T @ (p - y) + np.array([ridge * b[0], 0.0])
        hess = (m * (p * (1 - p))[:, None]).T @ m + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        b = b - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    if b[0] <= 0:
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return float(b[0]), float(b[1] - b[0] * centre)


def scored(lexicon: Lexicon, text: Column) -> Column:
    """Score of each text, 0 to 1; higher means that it is likelier toxic."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.of(t) for t in texts], dtype="float64")

    return run(text)
