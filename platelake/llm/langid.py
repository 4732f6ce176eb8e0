"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, inside words, word ends marked by a
space).  Everything is learned from all labelled rows: the embedding of a bucket from its exact share in every language,
the softmax from the mean embeddings of the rows, a temperature that makes it a calibrated confidence, and the rejection
limit.  The rows are dealt into folds by their texts, and what a row adds to softmax, temperature and limit comes from
embeddings of the other folds, so a text is never judged by itself.  ``train(per_lang=n)`` fits on a bounded sample instead,
embeddings and softmax together by stochastic gradient descent in numpy.

Defined cases: a NULL text or one without a letter gets ``und`` with score 0 and is rejected.  Without any labelled row
there is no model and every text gets ``und``.  With one language every text with a letter gets it with score 1.
A language that stands in one fold only is judged by embeddings of all rows.  Repeated rows are predicted alike; whole texts are read, in slices of bounded size.  Only the text enters a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from platelake.sources.workspace import stored

UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SLICE = 1 << 19
FOLDS = 4
# One text's share in a bucket is counted in units of this size, so that sums are exact.
UNIT = 1 << 24
TEMPERATURES = np.geomspace(0.05, 20, 60)

# ASCII letters stay (upper case lowered), other ASCII becomes a space, bytes above ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def subword_ids(text: str, bits: int) -> np.ndarray:
    """Bucket of every n-gram of the text (with repeats)."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - bits)
    out = []
    for start in range(0, max(len(text), 1), SLICE):
        raw = text[start:start + SLICE].lower().encode("utf-8", "replace").translate(_FOLD)
        folded = b" " + b" ".join(raw.split()) + b" "
        a = np.frombuffer(folded, np.uint8).astype(np.uint64)
        inner = a != 32
        gram = a
        for n in (2, 3, 4):
            if len(a) < n:
                break
            gram = (gram[:-1] << np.uint64(8)) | a[n - 1:]
            keep = np.ones(len(gram), bool)
            for k in range(1, n - 1):
                keep &= inner[k:k + len(gram)]
            if n == 2:
                keep &= inner[:-1] | inner[1:]
            out.append(((gram[keep] + np.uint64(n << 40)) * mult >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class Model:
    """``logits``: the embedding of each bucket already multiplied by the softmax matrix."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        counts = np.bincount(subword_ids(text, self.bits), minlength=1 << self.bits)
        z = (counts @ self.logits / max(int(counts.sum()), 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def scrambled(text: str) -> str:
    """The text with its letters in another order, spaces and lengths of words as they were: no language."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    each, at = np.unique(chars, return_inverse=True)
    where = np.flatnonzero(np.array([chr(c).isalpha() for c in each], bool)[at])
    chars[where] = chars[where][np.random.default_rng(len(where)).permutation(len(where))]
    return chars.tobytes().decode("utf-32-le", "surrogatepass")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], bits: int, dim: int = 16, epochs: int = 12, batch: int = 32,
        least_steps: int = 800, rate: float = 20.0, most_rejected: float = 0.001, seed: int = 7,
        foreign: list[tuple[np.ndarray, np.ndarray]] = (), foreign_caught: float = 0.95) -> Model:
    """Train on (bucket ids, counts, language) rows; every fifth row is kept for the calibration.

    The rejection limit is the calibrated confidence below which ``foreign_caught`` of the ``foreign`` rows (bucket ids and
    counts of texts in no language) fall, one half without such rows.  It is lower where it would cost more than
    ``most_rejected`` of the rightly predicted calibration rows.
    """
    langs = sorted({lang for *_, lang in rows})
    if not rows:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), 1.0, 0.0, bits)
    code = {lang: i for i, lang in enumerate(langs)}
    y = np.array([code[lang] for *_, lang in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kept = order[::5] if len(rows) >= 20 else order
    train = np.setdiff1d(order, kept) if len(rows) >= 20 else order
    size, n_lang = 1 << bits, len(langs)
    emb = rng.normal(0, 0.1, (size, dim))
    soft, bias = rng.normal(0, 0.3, (dim, n_lang)), np.zeros(n_lang)

    def shares(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that the rows use, and each row's share of n-grams in them."""
        used, at = np.unique(np.concatenate([rows[i][0] for i in part]), return_inverse=True)
        owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
        w = np.concatenate([rows[i][1] / max(rows[i][1].sum(), 1) for i in part])
        return used, np.bincount(owner * len(used) + at, w, len(part) * len(used)).reshape(len(part), len(used))

    each = max(1, -(-len(train) // batch))
    epochs = max(epochs, -(-least_steps // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        mixed = rng.permutation(train)
        for at in range(0, len(mixed), batch):
            part = mixed[at:at + batch]
            used, share = shares(part)
            x = share @ emb[used]
            g = softmax(x @ soft + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            lr = rate * (1 - done / steps)
            dx = g @ soft.T
            soft -= 0.05 * lr * x.T @ g
            bias -= 0.05 * lr * g.sum(axis=0)
            emb[used] -= lr * share.T @ dx
            done += 1

    parts = [shares(kept[at:at + batch]) for at in range(0, len(kept), batch)]
    z = np.concatenate([share @ emb[used] for used, share in parts]) @ soft + bias
    right = y[kept]
    temps = TEMPERATURES
    spread = np.full((len(kept), n_lang), 1 / (len(kept) + 2) / n_lang)  # smoothed targets: never quite sure
    spread[np.arange(len(kept)), right] += 1 - 1 / (len(kept) + 2)
    loss = [-(spread * np.log(softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in temps]
    temperature = float(temps[int(np.argmin(loss))])
    p = softmax(z / temperature)
    sure, ok = p.max(axis=1), p.argmax(axis=1) == right
    wanted = 0.5
    if len(foreign):
        size = 1 << bits
        x = np.stack([np.bincount(ids, n / max(n.sum(), 1), size) for ids, n in foreign]) @ emb
        wanted = float(np.quantile(softmax((x @ soft + bias) / temperature).max(axis=1), foreign_caught))
    limit = min(wanted, float(np.quantile(sure[ok], most_rejected))) if ok.any() else 0.0
    return Model(langs, emb @ soft, bias, temperature, limit, bits)


def train_on_sample(docs: DataFrame, usable: Column, per_lang: int, bits: int = 14, parts: int = 16,
                    calibration_rows: int = 20_000, most_rejected: float = 0.001) -> Model:
    """Fit on the ``per_lang`` usable rows of each language whose hashed id is smallest.

    The rows are chosen from ids alone, first inside ``parts`` parts of each language, so that a frequent one does not
    meet in one task; the last choice reads at most ``parts * per_lang`` ids a language.  An id may stand on many rows:
    equal ones are one, and of the others the ``per_lang`` with the smallest hashes of id and text are taken; NULL texts
    fall out.  The sparse n-gram counts of the chosen rows are made in tasks, and only those counts, at most
    ``2 ** bits`` for each row, reach the driver.  Every tenth chosen row is also counted with its letters scrambled, as
    text in no language for the rejection limit.

    A thousandth cannot be told from the few rows kept from training, so the limit is held below the ``most_rejected``
    quantile of the rightly predicted of about ``calibration_rows`` marked rows, chosen by another hash of the id.
    """
    marked = (docs.filter(usable & F.col("lang").isNotNull())
              .select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
              .withColumn("part", F.pmod("h", F.lit(parts))))
    for by in (["lang", "part"], ["lang"]):
        pick = Window.partitionBy(*by).orderBy("h", "doc_id")
        marked = marked.withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= per_lang).drop("n")
    ids = marked.select("doc_id").distinct()
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = (rows.join(F.broadcast(ids), "doc_id", "left_semi")
            .groupBy("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).agg(F.min("text").alias("text")))
    pick = Window.partitionBy("lang").orderBy("h", "t")
    rows = rows.withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= per_lang).drop("n")

    def counted(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            odd = [scrambled(t) for t, h in zip(texts, pdf["h"]) if h % 10 == 0]
            pdf = pd.concat([pdf.assign(foreign=False), pdf[pdf["h"] % 10 == 0].assign(foreign=True)])
            got = [np.unique(subword_ids(t, bits), return_counts=True) for t in texts + odd]
            yield pd.DataFrame({"h": pdf["h"], "t": pdf["t"], "lang": pdf["lang"], "foreign": pdf["foreign"],
                                "ids": [i.astype("<i4").tobytes() for i, _ in got],
                                "counts": [c.astype("<i4").tobytes() for _, c in got]})

    got = rows.mapInPandas(counted, "h long, t long, lang string, foreign boolean, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r["h"], r["t"], r["lang"]))
    cells = [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["lang"], r["foreign"]) for r in got if len(r["ids"])]
    model = fit([c[:3] for c in cells if not c[3]], bits, most_rejected=most_rejected, foreign=[c[:2] for c in cells if c[3]])
    known = docs.filter(usable & F.col("lang").isNotNull())
    share = min(1.0, calibration_rows / max(known.count(), 1))
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sure = (some.select("lang", predicted(model, F.col("text")).alias("p")).filter("p.lang_pred = lang")
            .agg(F.percentile_approx("p.score", most_rejected, 10_000)).first()[0])
    model.limit = model.limit if sure is None else min(model.limit, float(sure))
    return model


def shares(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its n-grams in each."""
    counts = np.bincount(subword_ids(text, bits), minlength=1 << bits)
    ids = np.flatnonzero(counts)
    return ids, counts[ids] / max(int(counts.sum()), 1)


def tallies(rows: DataFrame, bits: int) -> tuple[list[str], np.ndarray]:
    """Languages, and the sums of the rows' shares by fold, language and bucket, from (text, lang, fold) rows."""

    def told(total):
        for (lang, fold), units in total.items():
            at = np.flatnonzero(units)
            yield pd.DataFrame({"lang": lang, "fold": fold, "bucket": at, "units": units[at]})

    def counted(batches):
        total = {}
        for pdf in batches:
            for text, lang, fold in zip(pdf["text"], pdf["lang"], pdf["fold"]):
                ids, share = shares(text, bits)
                if len(ids) == 0:
                    continue
                if (lang, fold) not in total:
                    if len(total) >= 64:  # bounds what a task holds of many languages
                        yield from told(total)
                        total = {}
                    total[lang, fold] = np.zeros(1 << bits, np.int64)
                total[lang, fold][ids] += np.rint(share * UNIT).astype(np.int64)
        yield from told(total)

    got = (rows.mapInPandas(counted, "lang string, fold int, bucket int, units long")
           .groupBy("lang", "fold", "bucket").agg(F.sum(F.col("units").cast("double")).alias("units")).toArrow())
    names = got["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist()) if len(got) else []
    sums = np.zeros((FOLDS, len(langs), 1 << bits))
    if langs:
        place = np.array([langs.index(x) for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        sums[got["fold"].to_numpy(), place, got["bucket"].to_numpy()] = got["units"].to_numpy() / UNIT
    return langs, sums


def embeddings(sums: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding of every bucket from all rows, and those for the rows of each fold from the other folds.

    A bucket's embedding is the logarithm of its share in every language, less the mean over the languages; beyond ``dim``
    languages it is projected on the directions that hold most of the corpus.
    """

    def profile(of: np.ndarray) -> np.ndarray:
        size = of.shape[1]
        share = np.log((of + 1 / size) / (of.sum(axis=1, keepdims=True) + 1))
        return (share - share.mean(axis=0)).T

    whole = sums.sum(axis=0)
    others = [whole - fold for fold in sums]
    others = [np.where(rest.sum(axis=1, keepdims=True) > 0.5, rest, whole) for rest in others]
    every = profile(whole)
    if every.shape[1] > dim:
        heavy = every * whole.sum(axis=0)[:, None]
        axes = np.linalg.eigh(every.T @ heavy)[1][:, -dim:]
    else:
        axes = np.eye(every.shape[1])
    return every @ axes, np.stack([profile(rest) @ axes for rest in others])


def train_on_all(docs: DataFrame, usable: Column, bits: int = 14, dim: int = 16, most_rejected: float = 0.001,
                 foreign_caught: float = 0.95) -> Model:
    """Fit on all usable rows: one pass over the texts for the embeddings, one for the rows' mean embeddings.

    The second pass stores a short vector of each row, and another of its text with the letters scrambled, as text in no
    language; softmax, temperature and rejection limit are worked out on those.  What reaches the driver is bounded by the
    languages and buckets.  The limit is the confidence below which ``foreign_caught`` of the scrambled texts fall, or lower
    where that would cost more than ``most_rejected`` of the rightly predicted rows.
    """
    rows = (docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")))
    langs, sums = tallies(rows, bits)
    if len(langs) < 2:
        return Model(langs, np.zeros((1 << bits, len(langs))), np.zeros(len(langs)), 1.0, 0.0, bits)
    every, others = embeddings(sums, dim)
    code = {lang: i for i, lang in enumerate(langs)}

    def placed(batches):
        for pdf in batches:
            out = []
            for text, lang, fold in zip(pdf["text"], pdf["lang"], pdf["fold"]):
                for foreign, t in ((False, text), (True, scrambled(text))):
                    ids, share = shares(t, bits)
                    if len(ids):
                        out.append((float(code[lang]), foreign, (share @ others[fold][ids]).round(9)))
            yield pd.DataFrame(out, columns=["label", "foreign", "v"])

    points = stored(rows.mapInPandas(placed, "label double, foreign boolean, v array<double>"), "langid-points")
    known = points.filter("not foreign")
    fitted = LogisticRegression(family="multinomial", maxIter=50, regParam=1e-5).fit(
        known.select("label", array_to_vector("v").alias("features")))
    weights, bias = fitted.coefficientMatrix.toArray().round(6), np.array(fitted.interceptVector.toArray()).round(6)

    def losses(batches):
        total, n = np.zeros(len(TEMPERATURES)), 0
        for pdf in batches:
            if len(pdf):
                z = np.stack(pdf["v"]) @ weights.T + bias
                right = pdf["label"].to_numpy().astype(int)
                smooth = 1 / (n_rows + 2)  # smoothed targets: never quite sure
                for i, t in enumerate(TEMPERATURES):
                    log = np.log(softmax(z / t) + 1e-12)
                    total[i] -= (1 - smooth) * log[np.arange(len(z)), right].sum() + smooth * log.mean(axis=1).sum()
        yield pd.DataFrame({"i": np.arange(len(total)), "loss": total})

    n_rows = known.count()
    loss = known.mapInPandas(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    temperature = float(TEMPERATURES[min(loss, key=lambda r: (round(r["loss"], 6), r["i"]))["i"]])

    @F.pandas_udf("sure double, best int")
    def confidence(v: pd.Series) -> pd.DataFrame:
        p = softmax((np.stack(v) @ weights.T + bias) / temperature) if len(v) else np.zeros((0, len(langs)))
        return pd.DataFrame({"sure": p.max(axis=1), "best": p.argmax(axis=1)})

    judged = points.select("foreign", "label", confidence("v").alias("p"))
    wanted, held = judged.agg(
        F.percentile_approx(F.when(F.col("foreign"), F.col("p.sure")), foreign_caught, 100_000),
        F.percentile_approx(F.when(~F.col("foreign") & (F.col("p.best") == F.col("label")), F.col("p.sure")),
                            most_rejected, 100_000)).first()
    return Model(langs, every @ weights.T, bias, temperature, 0.0 if held is None else min(wanted, held), bits)


def train(docs: DataFrame, usable: Column, per_lang: int | None = None, bits: int = 14, parts: int = 16,
          calibration_rows: int = 20_000, most_rejected: float = 0.001) -> Model:
    """Fit on all usable rows, or, if ``per_lang`` is given, on so many of each language (``train_on_sample``)."""
    if per_lang is None:
        return train_on_all(docs, usable, bits, most_rejected=most_rejected)
    return train_on_sample(docs, usable, per_lang, bits, parts, calibration_rows, most_rejected)


def predicted(model: Model, text: Column) -> Column:
    """Struct of ``lang_pred`` and ``score`` for a text column."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=RESULT.names)

    return run(text)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``accepted`` (a language, at or above the model's limit); columns of these names in
    the input are replaced."""
    return (docs.withColumn("_lang", predicted(model, F.col(text)))
            .withColumns({"lang_pred": F.col("_lang.lang_pred"), "score": F.col("_lang.score")}).drop("_lang")
            .withColumn("accepted", (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= model.limit)))
