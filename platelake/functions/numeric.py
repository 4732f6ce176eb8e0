"""Order-independent arithmetic.

Money, quantities and multipliers are DOUBLE columns with at most four
decimals.  Summing them as scaled BIGINTs gives the same answer whatever order
partitions arrive in, keeps partial aggregation on fixed-width longs inside
whole-stage codegen, and avoids the slow DECIMAL accumulator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fixed(col: Column | str, scale: int = SCALE) -> Column:
    """Nearest BIGINT of ``col * scale``."""
    return F.floor(_c(col).cast("double") * F.lit(scale) + F.lit(0.5))


def fsum(col: Column | str, scale: int = SCALE) -> Column:
    """Exact SUM of a DOUBLE with a bounded number of decimals."""
    return F.sum(fixed(col, scale)) / F.lit(scale)


def favg(col: Column | str, scale: int = SCALE) -> Column:
    """Exact SUM divided by the number of non-NULL values."""
    return fsum(col, scale) / F.count(_c(col))


def rate(predicate: Column) -> Column:
    """Share of all rows where ``predicate`` is true; NULL counts as false."""
    return F.count_if(predicate) / F.count(F.lit(1))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` that is NULL, not an error, for a zero denominator."""
    return num / F.nullif(den, F.lit(0))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def half_up(num: Column, den: Column) -> Column:
    """Integer ``num / den`` rounded half up, exact; both non-negative BIGINT."""
    twice = 2 * num.cast("bigint") + den.cast("bigint")
    return _div(twice, 2 * den.cast("bigint"))


def _div(num: Column, den: Column) -> Column:
    """Whole-number quotient of two BIGINT columns, without doubles."""
    return ((num - F.pmod(num, den)).cast("decimal(20,0)") / den.cast("decimal(20,0)")).cast("bigint")
