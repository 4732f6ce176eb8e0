"""Joins of facts with a smaller side, without hot tasks.

A fact table joined on a key with few, very frequent values (one store, anonymous guests with a NULL key) sends all rows of
such a value to one task.  Here those rows get a salt, and the matching rows of the smaller side are replicated once for each
salt; all other rows stay as they are.  NULL keys never match, so they are only spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def heavy_keys(left: DataFrame, on: str, share: float = 0.02, tracked: int = 1000) -> list:
    """Keys with at least ``share`` of the rows that have one, from a top-k sketch of one pass; at most ``1 / share`` of them.

    The sketch overestimates by less than its own error, about the rows divided by ``tracked``: a key may be named that is
    somewhat rarer, none that is heavier is missed.
    """
    found = left.filter(F.col(on).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{on}`, {min(tracked, int(2 / share))}, {tracked})").alias("top")).first()
    return [] if not found.rows else [t["item"] for t in found.top if t["count"] >= share * found.rows]


def left_join(left: DataFrame, right: DataFrame, on: str, heavy: list | tuple = (), salts: int = SALTS) -> DataFrame:
    """``left.join(right, on, "left")`` with NULL and ``heavy`` keys of the left side dealt over ``salts`` tasks.

    ``right`` should hold few rows for each heavy key, as they are copied ``salts`` times.
    """
    salt = "_salt"
    while salt in left.columns or salt in right.columns:
        salt += "_"
    hot = F.col(on).isin(*heavy) if heavy else F.lit(False)
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    dealt = left.withColumn(salt, F.when(F.col(on).isNull() | hot, turn).otherwise(0))
    one = F.array(F.lit(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(one) if heavy else one
    # Exploded also where it is always 0: a literal is folded into a condition, and then NULL keys meet in one task.
    spread = right.filter(F.col(on).isNotNull()).withColumn(salt, F.explode(copies))
    return dealt.join(spread, [on, salt], "left").drop(salt)
