"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations of the 32-bit universe give all signature coordinates: the first one shuffles the shingle hashes once,
the second one is read shifted by one place more for each further coordinate, ``h_k(S) = min over x of P2(P1(x) + k)``
(sums modulo the size of the universe).  Coordinates are banded; documents that share a band value are candidates, and a
link needs ``100 * intersection >= 75 * union`` on the full shingle sets, made again from the whole texts.

Large groups never become all pairs:

* documents with equal shingle sets are one class, represented by its smallest id;
* first, each representative is verified only against the bucket centre (smallest id) it shares most bands with, which
  joins a family of near copies by a star instead of by pairs;
* then only buckets with several components are looked at, in blocks of bounded size.  A pair of different components
  counts in the first band it shares, if its sketches (one byte for each coordinate) leave the threshold possible; the
  full sets of such documents meet in the block and give at most one link for each step that joins two components.

Components come from alternating large-star and small-star steps on DataFrames.  With 40 bands of 4 rows a pair at the
threshold itself is missed with a probability of 3e-7; the sketch test leaves out a linked pair with one below 1e-9.

Defined cases: NULL or empty texts, or texts without words, have no shingles and are linked with nothing.  Rows with
one doc_id are one document whose text is the largest of theirs; all of them get its result.  NULL ids are kept as a row
of their own with NULL component and kept = true.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelake.llm.ids import as_key, from_key
from platelake.llm.shingles import mix, shingles
from platelake.sources.workspace import stored

BANDS, ROWS = 40, 4
THRESHOLD = 0.75
BLOCK = 2048
_MARGIN = 6.0


def permute(x: np.ndarray, keys: tuple[int, int]) -> np.ndarray:
    """A permutation of the 32-bit universe (in place); every pair of odd keys gives another one."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(keys[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(keys[1])
    x ^= x >> np.uint32(16)
    return x


# The odd keys of the two permutations.
FIRST, SECOND = (0x7FEB352D, 0x846CA68B), (0x85EBCA6B, 0xC2B2AE35)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a shingle set."""
    first = permute((hashes >> np.uint64(32)).astype(np.uint32), FIRST)
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    for at in range(0, len(first), 512):
        np.minimum(best, permute(first[None, at:at + 512] + shift, SECOND).min(axis=1), out=best)
    return best


def bands(sig: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit value for each band, different between bands."""
    part = sig.reshape(n, rows).astype(np.uint64)
    value = mix(np.arange(1, n + 1, dtype=np.uint64))
    for k in range(rows):
        value = mix(value + part[:, k])
    return value.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (two longs), bands, sketch (low byte of each coordinate)."""

    def run(parts):
        for pdf in parts:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                s = shingles(text)
                if len(s) == 0:
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                sig = signature(s)
                a = int(s.sum(dtype=np.uint64).astype(np.int64))
                b = int(mix(s).sum(dtype=np.uint64).astype(np.int64))
                rows.append((doc_id, len(s), a, b, bands(sig), (sig & 0xFF).astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"])
            yield out.astype({"n_shingles": "int64", "fp1": "Int64", "fp2": "Int64"})

    return docs.select(as_key("doc_id"), "text").mapInPandas(
        run, "doc_id string, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary").withColumn(
        "doc_id", from_key("doc_id"))


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and s (its sorted shingle hashes, little-endian) of the wanted documents, from their whole texts."""

    def sets(parts):
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "s": [shingles(t).astype("<u8").tobytes() for t in pdf["text"]]})

    return stored(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
                  .mapInPandas(sets, "doc_id long, s binary"), "neardup-sets")


def verified(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    whole = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    percent = round(100 * threshold)

    def check(parts):
        for pdf in parts:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]]

    both = (pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(whole.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))
    return stored(both.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long"), "neardup-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u != v").distinct(), "components")
    last = None
    while True:
        # Large star: every larger neighbour moves to the smallest neighbour.
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # Small star: the smaller neighbours and the node itself move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = stored(small, "components")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def blocks_of(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several components: key, i, j, own (block), doc, comp.

    A large bucket is dealt in pairs of blocks, each with at most about twice BLOCK documents.
    """
    told = (buckets.join(labels.withColumnRenamed("node", "doc"), "doc", "left")
            .select("key", "doc", F.coalesce("component", "doc").alias("comp")))
    several = (told.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .filter("lo != hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    return (told.join(several, "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "comp"))


class Block:
    """Documents of one block pair of a bucket, and the pairs that must be looked at there.

    A pair counts only in the first band it shares, in the block pair that separates or holds both, if the components
    differ and the sketches leave the threshold possible.
    """

    def __init__(self, pdf: pd.DataFrame, enough: int):
        self.doc, self.comp, self.own = (pdf[c].to_numpy() for c in ("doc", "comp", "own"))
        self.key, self.one = pdf["key"].iloc[0], bool(pdf["i"].iloc[0] == pdf["j"].iloc[0])
        self.sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        self.bands = np.stack(pdf["bands"].to_numpy())
        self.enough = enough

    def partners(self, k: int) -> np.ndarray:
        to = np.arange(k + 1, len(self.doc)) if self.one else np.flatnonzero(self.own > self.own[k])
        to = to[self.comp[to] != self.comp[k]]
        to = to[(self.sketch[to] == self.sketch[k]).sum(axis=1) >= self.enough]
        if len(to):
            shared = self.bands[to] == self.bands[k]
            to = to[self.bands[k][shared.argmax(axis=1)] == self.key]
        return to

    def involved(self) -> np.ndarray:
        """Rows with at least one partner."""
        hit = np.zeros(len(self.doc), bool)
        for k in range(len(self.doc)):
            to = self.partners(k)
            hit[to] = True
            hit[k] |= len(to) > 0
        return np.flatnonzero(hit)

    def links(self, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
        """Verified links, at most one for each step that joins two components."""
        root = {c: c for c in self.comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for k in range(len(self.doc)):
            to = self.partners(k)
            if len(to) == 0:
                continue
            mine = sets[k]
            for x in to.tolist():
                a, b = top(int(self.comp[k])), top(int(self.comp[x]))
                if a == b:
                    continue
                other = sets[x]
                if 100 * min(len(mine), len(other)) < percent * max(len(mine), len(other)):
                    continue
                at = np.searchsorted(mine, other)
                both = int((mine[np.minimum(at, len(mine) - 1)] == other).sum())
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    root[max(a, b)] = min(a, b)
                    found.append((int(self.doc[k]), int(self.doc[x])))
        return found


def grouped(batches, names: list[str]):
    """The frames of equal ``names`` values, from batches sorted by them."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if len(pdf) == 0:
            continue
        mark = pdf[names]
        cut = np.flatnonzero((mark != mark.shift()).any(axis=1).to_numpy())
        for a, b in zip(cut[:-1], cut[1:]):
            yield pdf.iloc[a:b]
        rest = pdf.iloc[cut[-1]:]
    if rest is not None:
        yield rest


def crossing(docs: DataFrame, buckets: DataFrame, sketches: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between different components inside the buckets.

    First the sketches alone tell which members have a partner at all; only their shingle sets are then dealt, and the
    sets are compared where they meet, so the rows made are at most the members, never the pairs.
    """
    spread = np.sqrt(threshold * (1 - threshold) / (BANDS * ROWS))
    enough, percent = int(np.floor((threshold - _MARGIN * spread) * BANDS * ROWS)), round(100 * threshold)
    keys = ["key", "i", "j"]
    columns = [*keys, "own", "doc", "comp"]

    def chosen(batches):
        for pdf in grouped(batches, keys):
            if len(pdf) > 1:
                yield pdf.iloc[Block(pdf, enough).involved()][columns]

    def compared(batches):
        for pdf in grouped(batches, keys):
            sets = [np.frombuffer(s, "<u8") for s in pdf["s"]]
            yield pd.DataFrame(Block(pdf, enough).links(sets, percent), columns=["a", "b"], dtype="int64")

    members = blocks_of(buckets, labels).join(sketches, "doc").repartition(*keys).sortWithinPartitions(*keys, "doc")
    needed = stored(members.select(*columns, "sketch", "bands").mapInPandas(
        chosen, "key long, i int, j int, own int, doc long, comp long"), "neardup-members")
    sets = shingle_sets(docs, needed.select(F.col("doc").alias("doc_id")).distinct())
    whole = (needed.join(sketches, "doc").join(sets.withColumnRenamed("doc_id", "doc"), "doc").repartition(*keys)
             .sortWithinPartitions(*keys, "doc").select(*columns, "sketch", "bands", "s"))
    return stored(whole.mapInPandas(compared, "a long, b long"), "neardup-links")


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The ids that several rows carry; stored, so that the planner knows how few they are."""
    return stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"),
                  "neardup-repeated")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    again = repeated_ids(docs)
    if again.isEmpty():
        return _of_distinct_ids(docs, threshold)
    copies = docs.select("doc_id").join(again, "doc_id", "left_semi")
    largest = (docs.select("doc_id", "text").join(again, "doc_id", "left_semi")
               .groupBy("doc_id").agg(F.max("text").alias("text")))
    single = docs.select("doc_id", "text").join(again, "doc_id", "left_anti").union(largest)
    found = stored(_of_distinct_ids(stored(single, "neardup-texts"), threshold), "neardup-found")
    return found.join(again, "doc_id", "left_anti").union(copies.join(found, "doc_id"))


def _of_distinct_ids(docs: DataFrame, threshold: float) -> DataFrame:
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    all_rows = stored(sketched(docs), "neardup-sketches")
    known = all_rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(known.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "neardup-classes")
    firsts = classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2").join(known, ["doc_id", "fp1", "fp2"]) \
        .dropDuplicates(["doc_id"])
    values = stored(firsts.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("key")), "neardup-bands")
    shared = (values.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("centre")).filter("n > 1")
              .select("key", "centre"))
    buckets = stored(values.join(shared, "key"), "neardup-buckets")
    reps = texts.join(buckets.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sketches = firsts.select(F.col("doc_id").alias("doc"), "sketch", "bands")

    star = (buckets.filter("doc != centre").groupBy("doc", "centre").count()
            .groupBy("doc").agg(F.max_by("centre", F.struct("count", -F.col("centre"))).alias("centre")))
    links = verified(reps, star.select(F.col("centre").alias("a"), F.col("doc").alias("b")), threshold)
    labels = stored(components(links), "neardup-labels")
    links = links.union(crossing(reps, buckets.select("key", "doc"), sketches, labels, threshold))
    labels = stored(components(links), "neardup-labels")

    final = (classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .select("fp1", "fp2", F.coalesce("component", "rep").alias("component")))
    out = all_rows.select("doc_id", "n_shingles", "fp1", "fp2").join(final, ["fp1", "fp2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, one for each doc_id, with all columns; rows with NULL ids stay."""
    found = stored(near_duplicates(docs, threshold), "neardup-result").filter("doc_id IS NOT NULL")
    dropped = found.filter("NOT kept").select("doc_id").distinct()
    several = found.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    once = docs.join(dropped.union(several).distinct(), "doc_id", "left_anti")
    more = docs.join(several.join(dropped, "doc_id", "left_anti"), "doc_id", "left_semi")
    # All copies of a repeated id are one document, whose text is the largest of theirs.
    first = more.groupBy("doc_id").agg(F.max_by(
        F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*docs.columns)))).alias("row"))
    return once.select(*docs.columns).union(first.select("row.*"))
