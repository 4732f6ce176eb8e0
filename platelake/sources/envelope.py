"""Batch and stream readers of append-only envelope tables, and ingestion marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_batch(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet table; a declared schema fills columns missing from older files with NULL."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def read_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The same table as a stream of appended files."""
    return spark.readStream.schema(schema).parquet(path)


def lookup(unit: DataFrame) -> DataFrame:
    """The three unit columns the silver joins need."""
    return unit.select("unit_id", "franchisee_id", "region_id")


def high_water_mark(order_events: DataFrame, source: str = "otel") -> DataFrame:
    """Newest event of one source; NULL on the first run."""
    return order_events.filter(F.col("source") == source).agg(F.max("event_ts").alias("high_water_mark"))


def resume_point(*envelopes: DataFrame) -> DataFrame:
    """First full hour after the newest event of any envelope table."""
    newest = reduce(DataFrame.unionByName, [e.agg(F.max("event_ts").alias("event_ts")) for e in envelopes])
    return newest.agg((F.date_trunc("hour", F.max("event_ts")) + F.expr("INTERVAL 1 HOUR")).alias("resume_at"))
