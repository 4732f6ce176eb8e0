"""Packing: concatenate and cut.

The token streams of all documents, each closed by an end id, are laid one after the other and cut into windows.  Two
passes give the place of every document: the first one encodes, keeps a running sum inside each partition and stores the
ids with it; prefix sums over the partition totals then give each partition its global offset.  The second pass cuts
where a document meets a window edge, which yields one piece for each window the document touches (boundary pieces are
marked).  No row is shuffled, and a document in two windows never meets another one in a task.

Every sequence but the last is full, so padding is at most one window for the whole corpus.

Ids are those of the ``tokenizers`` file with ``add_special_tokens=False``.  They are made by tiktoken from the same
vocabulary, about five times as fast; texts that its pattern engine refuses go to ``tokenizers`` itself.

Defined cases: a NULL or empty text is the end id alone.  Repeated rows are packed as often as they come, rows
without an id too.  An empty table gives no piece.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelake.llm.ids import as_key, from_key
from platelake.sources.workspace import stored

WINDOW = 1024
END_ID = 0
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, "
          "ids binary")


@lru_cache(maxsize=2)
def _fast(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={"<|endoftext|>": len(ranks)})


@lru_cache(maxsize=2)
def _plain(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def encode(text: str | None, json_path: str = JSON, ranks_path: str = RANKS) -> list[int]:
    if not text:
        return []
    fast = _fast(ranks_path)
    try:
        return fast.encode(text, allowed_special="all")
    except BaseException as err:  # a panic of the pattern engine is no Exception
        if isinstance(err, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return _plain(json_path).encode(text, add_special_tokens=False).ids


def encoded(docs: DataFrame, json_path: str = JSON, ranks_path: str = RANKS, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, start (tokens before it in the partition), n, ids (two-byte or four-byte little-endian)."""

    def run(parts):
        part, start = TaskContext.get().partitionId(), 0
        for pdf in parts:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text, json_path, ranks_path)
                ids.append(end_id)
                wide = max(ids) > 0xFFFF
                rows.append((doc_id, part, start, len(ids), wide, np.array(ids, "<u4" if wide else "<u2").tobytes()))
                start += len(ids)
            yield pd.DataFrame(rows, columns=["doc_id", "part", "start", "n", "wide", "ids"])

    return docs.select(as_key("doc_id"), "text").mapInPandas(
        run, "doc_id string, part int, start long, n long, wide boolean, ids binary").withColumn("doc_id", from_key("doc_id"))


def packed(docs: DataFrame, window: int = WINDOW, json_path: str = JSON, ranks_path: str = RANKS,
           end_id: int = END_ID) -> DataFrame:
    """One row for each piece: PIECES, with ids as little-endian unsigned 32-bit numbers."""
    tokens = stored(encoded(docs, json_path, ranks_path, end_id), "packing-tokens")
    # One total for each partition of the input: bounded by the number of tasks, not of rows.
    totals = sorted(map(tuple, tokens.groupBy("part").agg(F.sum("n")).collect()))
    before = np.concatenate([[0], np.cumsum([n for _, n in totals], dtype=np.int64)])
    base = {part: int(at) for (part, _), at in zip(totals, before)}

    def cut(parts):
        for pdf in parts:
            rows = []
            for doc_id, part, start, n, wide, raw in zip(*(pdf[c] for c in ("doc_id", "part", "start", "n", "wide",
                                                                           "ids"))):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                at, place = 0, base[part] + int(start)
                while at < n:
                    offset = (place + at) % window
                    length = min(window - offset, n - at)
                    rows.append((doc_id, at, length, n, (place + at) // window, offset, length < n,
                                 ids[at:at + length].tobytes()))
                    at += length
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=NAMES)
                        rows = []
            yield pd.DataFrame(rows, columns=NAMES)

    pieces = tokens.withColumn("doc_id", as_key("doc_id")).mapInPandas(cut, PIECES.replace("doc_id long", "doc_id string"))
    return pieces.withColumn("doc_id", from_key("doc_id"))


NAMES = [c.split()[0] for c in PIECES.split(", ")]
