"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups of equal texts are the items.  Placing is greedy, each item going to the shard where the dot product of its
(bytes, tokens, rows) vector with the shard's residual capacity is highest among the shards it fits into.  Groups above
``alone`` of the whole in any dimension (there are at most ``3 / alone`` of them) are placed one by one; the many smaller
ones are bundled into ``parcels`` by the hash of their text, so the driver sees a bounded number of items at any input size.
Only a group that no shard can hold is cut, by the hash of the id, into pieces of about ``piece`` of the whole; pieces as
large as a shard would fill its rows long before its bytes where the group's text is short.

Slots number the rows of a shard without gaps: an offset for each item from prefix sums over the items, plus a row
number inside the item, large ones in slices, so no task sees a whole shard or a whole large group.

Defined cases: NULL and empty texts are one group of size 1 a row.  Rows of one group go to one shard unless the group is
cut; a cut group's rows with one id stay together, and its rows without an id are cut by their place in the table.  Ties
are broken by item number and id, so reruns agree.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platelake.sources.workspace import stored

PARCELS = 4096
ALONE = 1 / 2048
PIECE = 1 / 256
SIZES = ("size", "tokens", "one")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``items``: its size in each dimension), largest items first.

    Where an item fits into no shard, the first dimension, the one that must come out even, decides: shards with room in it,
    else the shard that it overfills least.
    """
    total = items.sum(axis=0)
    unit = items / np.where(total > 0, total, 1)
    left = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in sorted(range(len(items)), key=lambda k: (-unit[k].max(), k)):
        fits = (left >= unit[i] - 1e-12).all(axis=1)
        if not fits.any():
            fits = left[:, 0] >= unit[i, 0] - 1e-12
        worth = np.where(fits, left @ unit[i], -np.inf) if fits.any() else left[:, 0]
        best = int(worth.argmax())
        left[best] -= unit[i]
        out[i] = best
    return out


def sharded(docs: DataFrame, shards: int = 8, parcels: int = PARCELS, alone: float = ALONE,
            piece: float = PIECE) -> DataFrame:
    """doc_id, size, tokens, text_crc32, item, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.lit(17), F.coalesce("doc_id", F.monotonically_increasing_id())).alias("deal")), "sharding-rows")
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    whole = rows.agg(*[F.sum(c).alias(c) for c in SIZES]).first()
    total = [max(int(x or 0), 1) for x in whole]
    sums = [F.sum(c).alias(c) for c in SIZES]
    share = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(SIZES, total)])
    large = (rows.groupBy("text_hash").agg(*sums).withColumn("share", share).filter(F.col("share") > alone)
             .select("text_hash", "share").orderBy("text_hash").collect())  # at most 3 / alone rows
    first, known = parcels, []
    for group in large:
        pieces = int(np.ceil(group["share"] / piece)) if group["share"] * shards > 1 else 1
        known.append((group["text_hash"], first, pieces, int(np.ceil(group["share"] / pieces / alone))))
        first += pieces
    known = F.broadcast(spark.createDataFrame(known, "text_hash long, first int, pieces int, slices int"))
    # Large items are numbered in slices, so no task sorts a whole one.
    rows = (rows.join(known, "text_hash", "left")
            .withColumn("item", F.coalesce(F.col("first") + F.pmod("deal", F.col("pieces")).cast("int"),
                                           F.pmod("text_hash", F.lit(parcels)).cast("int")))
            .withColumn("slice", F.coalesce(F.pmod(F.xxhash64("deal"), F.col("slices")).cast("int"), F.lit(0)))
            .drop("first", "pieces", "slices"))
    cells = sorted(map(tuple, rows.groupBy("item", "slice").agg(*sums).collect()))  # at most parcels + 6 / alone + 3 / piece rows
    sizes: dict[int, np.ndarray] = {}
    for item, _, *size in cells:
        sizes[item] = sizes.get(item, 0) + np.array(size, np.float64)
    shard_of = dict(zip(sizes, place(np.array(list(sizes.values())).reshape(-1, len(SIZES)), shards)))
    used, places = [0] * shards, []
    for item, slice_, _, _, n in cells:
        shard = int(shard_of[item])
        places.append((item, slice_, shard, used[shard]))
        used[shard] += n
    placed = spark.createDataFrame(places, "item int, slice int, shard int, base long")
    inside = Window.partitionBy("item", "slice").orderBy("doc_id", "size", "text_crc32")
    return (rows.withColumn("at", F.row_number().over(inside)).join(F.broadcast(placed), ["item", "slice"])
            .select("doc_id", "size", "tokens", "text_crc32", "item", "shard",
                    (F.col("base") + F.col("at") - 1).alias("slot")))
