"""Deterministic surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(p) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(str(p))


def digest(*parts) -> Column:
    """Hex SHA-256 of the parts joined by ':'; plain values become literals."""
    return F.sha2(F.concat_ws(":", *[_part(p) for p in parts]), 256)


def make_id(*parts) -> Column:
    """56-bit BIGINT key: the first 14 hex digits of :func:`digest`."""
    return F.conv(F.substring(digest(*parts), 1, 14), 16, 10).cast("bigint")


def event_key(*parts) -> Column:
    """16-character hex key of :func:`digest`; a NULL part counts as empty, so that it keeps its place."""
    return F.substring(digest(*[F.coalesce(_part(p), F.lit("")) for p in parts]), 1, 16)
