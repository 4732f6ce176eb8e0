"""Registered queries: a function of ``Tables`` and, where possible, a check in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake.plans.catalog import Tables
from platelake.plans.duck import oracle

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, text: tuple[str, ...] = ()):
    """Register a query; ``text`` names its date and timestamp columns."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = oracle(sql, text)
        return fn

    return keep


def as_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, so results compare across engines."""
    return df.select(*[F.col(f"`{n}`").cast("string").alias(n) if t in ("date", "timestamp", "timestamp_ntz")
                       else F.col(f"`{n}`") for n, t in df.dtypes])


def run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(QUERIES[key](Tables(spark, sf_dir)))
