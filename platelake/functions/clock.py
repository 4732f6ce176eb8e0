"""Explicit 'now' for trailing windows.

Every windowed operator takes ``as_of`` instead of reading the wall clock.  When
it is omitted the clock is the newest event of the source, evaluated as a lazy
scalar subquery, so a whole query stays one plan and the bound can be pushed to
the scan once known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, ts: str) -> Column:
    return df.agg(F.max(ts)).scalar()


def _now(df: DataFrame, ts: str, as_of: Column | None) -> Column:
    return newest(df, ts) if as_of is None else as_of


def last_days(df: DataFrame, ts: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows with ``ts`` at most ``days`` x 24 h before the clock."""
    return df.filter(F.col(ts) >= _now(df, ts, as_of) - F.make_dt_interval(F.lit(days)))


def since_date(df: DataFrame, ts: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows from midnight ``days`` days before the clock's date."""
    start = F.date_sub(F.to_date(_now(df, ts, as_of)), days)
    return df.filter(F.col(ts) >= start.cast("timestamp"))


def month_to_date(df: DataFrame, ts: str, as_of: Column | None = None) -> DataFrame:
    return df.filter(F.col(ts) >= F.date_trunc("month", _now(df, ts, as_of)))
