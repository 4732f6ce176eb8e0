"""Ids on their way through pandas, which turns a long column with a NULL into doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_key(name: str) -> Column:
    """The id as text, the empty text for NULL, under the same name."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def from_key(name: str) -> Column:
    """The id of a text made by ``as_key``."""
    return F.col(name).try_cast("bigint").alias(name)
