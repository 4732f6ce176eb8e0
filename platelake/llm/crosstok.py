"""Alignment of the tokens of two tokenizers by lockstep vectorised merging.

Each document is encoded with a leading space by a byte-level BPE (A) and a piece model (B).  The end offsets of both token
rows are merged for many documents at once: one numpy state vector holds the A and the B pointer of every lane, a step
compares all pairs of ends, emits a link and a cut where they meet, moves the pointers behind and compacts finished lanes.
A lane is a document, or a run of ``LANE`` tokens of a long one: whether an offset is a cut does not depend on where the
merge began, so one very long text does not prolong the steps of the others.

Two tokens that end together lie one in the other, so the shorter is a suffix of the longer.  The pairs that can be
linked at all follow from the two vocabularies (some 100,000); a document stores its links as numbers of such pairs, and the
counts of the whole corpus are one array of that size, whatever the corpus: this is what is collected and broadcast.

Defined cases: NULL and empty texts, and texts that a tokenizer does not keep byte for byte (a U+2581 in the text, say), have
zeros and an empty digest.  Repeated rows, and rows without an id, are documents of their own and count each time.  An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelake.llm.ids import as_key, from_key
from platelake.sources.workspace import stored

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LANE = 256
BATCH_CHARS = 1 << 20
LINKED = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, "
          "times binary")
RESULT = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


@dataclass(frozen=True)
class Files:
    json: str = JSON
    ranks: str = RANKS
    pieces: str = PIECES


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(files.json)
        self.plain.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece_bytes(i) for i in range(self.piece.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece_bytes(self, i: int) -> bytes:
        if self.piece.is_byte(i):
            return bytes([int(self.piece.id_to_piece(i)[3:-1], 16)])
        if self.piece.is_control(i) or self.piece.is_unknown(i):
            return b""
        return self.piece.id_to_piece(i).replace("▁", " ").encode("utf-8")

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as err:  # the pattern engine's panic is no Exception
            if type(err).__name__ != "PanicException":
                raise
            return self.plain.encode(text, add_special_tokens=False).ids

    def both(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B; none where a side does not give back the bytes."""
        if not text:
            return [], []
        raw = (" " + text).encode("utf-8")
        a, b = self.encode_a(" " + text), self.piece.encode(text)
        same = (b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
                and all(map(self.b_bytes.__getitem__, b)))
        return (a, b) if same else ([], [])

    @property
    def pairs(self) -> np.ndarray:
        """All id pairs (A in the upper half) of which one token's bytes end the other's, ascending."""
        if not hasattr(self, "_pairs"):
            of_a, of_b = _ids_of(self.a_bytes), _ids_of(self.b_bytes)
            found = {a << 32 | b for token, ids in of_a.items() for k in range(len(token))
                     for b in of_b.get(token[k:], ()) for a in ids}
            found |= {a << 32 | b for token, ids in of_b.items() for k in range(1, len(token))
                      for a in of_a.get(token[k:], ()) for b in ids}
            self._pairs = np.array(sorted(found), np.uint64)
        return self._pairs


def _ids_of(tokens: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, token in enumerate(tokens):
        if token:
            out.setdefault(token, []).append(i)
    return out


@lru_cache(maxsize=2)
def tokenizers(files: Files) -> Tokenizers:
    return Tokenizers(files)


@lru_cache(maxsize=2)
def _labels(n: int) -> list[str]:
    """Decimal id and what follows it: nothing, a comma, a bar or a semicolon."""
    return [f"{i}{end}" for i in range(n) for end in ("", ",", "|", ";")]


def merge(a_end: np.ndarray, b_end: np.ndarray, a_of: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the A and B tokens that end together, ascending.

    ``a_end`` and ``b_end`` are end offsets of all documents laid one after the other, both strictly ascending and with
    the same document ends; ``a_of`` holds the first A index of each document that has tokens, and the number of A tokens.
    """
    starts = np.concatenate([np.arange(lo, hi, lane) for lo, hi in zip(a_of[:-1], a_of[1:])] or [np.empty(0, np.int64)])
    stops = np.append(starts[1:], len(a_end)) if len(starts) else starts
    pa, stop = starts.astype(np.int64), stops.astype(np.int64)
    before = np.where(pa > 0, a_end[pa - 1], 0) if len(pa) else pa
    pb = np.searchsorted(b_end, before, side="right")
    cut_a, cut_b = [], []
    while len(pa):
        ea, eb = a_end[pa], b_end[pb]
        meet = ea == eb
        cut_a.append(pa[meet])
        cut_b.append(pb[meet])
        pa = pa + (ea <= eb)
        pb = pb + (eb <= ea)
        going = pa < stop
        if not going.all():
            pa, pb, stop = pa[going], pb[going], stop[going]
    if not cut_a:
        return starts.astype(np.int64), starts.astype(np.int64)
    return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))


def align(texts: list[str | None], files: Files = Files(), lane: int = LANE) -> list[tuple]:
    """For each text: n_a, n_b, n_groups, n_links, digest, numbers of its pairs (ascending) and how often each is linked."""
    t = tokenizers(files)
    ids = [t.both(x) for x in texts]
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.array(list(chain.from_iterable(x[k] for x in ids)), np.int64) for k in (0, 1))
    a_at, b_at = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    cut_a, cut_b = merge(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]), np.unique(a_at), lane)
    pairs = np.searchsorted(t.pairs, (a[cut_a].astype(np.uint64) << np.uint64(32)) | b[cut_b].astype(np.uint64))
    # Every group is its A tokens, then its B tokens: the place of each token in the text of the digest.
    group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    group_a[cut_a[:-1] + 1] = 1
    group_b[cut_b[:-1] + 1] = 1
    group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
    end_a, end_b = np.ones(len(a), np.int64), np.ones(len(b), np.int64)
    end_a[cut_a], end_b[cut_b] = 2, 3
    end_b[b_at[1:][n_b > 0] - 1] = 0
    row = np.empty(len(a) + len(b), np.int64)
    b_before, a_through = np.append(0, cut_b + 1), cut_a + 1
    row[np.arange(len(a)) + b_before[group_a]] = a * 4 + end_a
    row[np.arange(len(b)) + (a_through[group_b] if len(b) else 0)] = b * 4 + end_b
    labels = _labels(max(len(t.a_bytes), len(t.b_bytes)))
    at = np.searchsorted(cut_a, a_at)
    out = []
    for k in range(len(texts)):
        lo, hi = int(a_at[k] + b_at[k]), int(a_at[k + 1] + b_at[k + 1])
        digest = hashlib.sha256("".join(map(labels.__getitem__, row[lo:hi].tolist())).encode()).hexdigest() if hi > lo else ""
        number, times = np.unique(pairs[at[k]:at[k + 1]], return_counts=True)
        groups = int(at[k + 1] - at[k])
        out.append((int(n_a[k]), int(n_b[k]), groups, groups, digest, number, times))
    return out


def linked(docs: DataFrame, files: Files = Files()) -> DataFrame:
    """LINKED: a row for each document, its links as pair numbers and counts (little-endian unsigned 32-bit)."""

    def run(parts):
        for pdf in parts:
            keys, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            size = np.cumsum([len(t) if t else 1 for t in texts]) // BATCH_CHARS
            edges = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(texts)]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                got = align(texts[lo:hi], files)
                yield pd.DataFrame(
                    [(key, *x[:5], x[5].astype("<u4").tobytes(), x[6].astype("<u4").tobytes())
                     for key, x in zip(keys[lo:hi], got)], columns=[c.split()[0] for c in LINKED.split(", ")])

    return docs.select(as_key("doc_id"), "text").mapInPandas(run, LINKED)


def pair_counts(links: DataFrame, files: Files = Files()) -> np.ndarray:
    """Links of each pair number in all documents; the array has the size of the vocabularies' pair list."""
    n = len(tokenizers(files).pairs)

    def run(parts):
        total = np.zeros(n, np.int64)
        for pdf in parts:
            number, times = (np.frombuffer(b"".join(pdf[c]), "<u4") for c in ("pairs", "times"))
            total += np.bincount(number, times, n).astype(np.int64)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"pair": used, "n": total[used]})

    got = (links.select("pairs", "times").mapInPandas(run, "pair long, n long")
           .groupBy("pair").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(n, np.int64)
    counts[got["pair"].to_numpy()] = got["n"].to_numpy()
    return counts


def best_of(counts: np.ndarray, files: Files = Files()) -> np.ndarray:
    """Whether a pair's count is the highest of its B id."""
    b = (tokenizers(files).pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(int(b.max()) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return (counts > 0) & (counts == highest[b])


def aligned(docs: DataFrame, files: Files = Files()) -> DataFrame:
    """RESULT for each document (doc_id long)."""
    links = stored(linked(docs, files), "crosstok-links")
    counts = pair_counts(links, files)
    shared = docs.sparkSession.sparkContext.broadcast((counts, best_of(counts, files)))

    def run(parts):
        count, best = shared.value
        for pdf in parts:
            n_best, total = [], []
            for raw, raw_times in zip(pdf["pairs"], pdf["times"]):
                number, times = np.frombuffer(raw, "<u4"), np.frombuffer(raw_times, "<u4").astype(np.int64)
                n_best.append(int(times[best[number]].sum()))
                total.append(int((times * count[number]).sum()))
            yield pd.DataFrame({**{c: pdf[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
                                "n_best": n_best, "count_sum": total, "groups_sha256": pdf["groups_sha256"]})

    return links.mapInPandas(run, RESULT).withColumn("doc_id", from_key("doc_id"))
