"""Writers: append by route in one commit, overwrite, CSV export.  Keyed upserts are in ``keyed``."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake import schemas
from platelake.sources.commits import Files
from platelake.sources.workspace import fresh, lookup, settled, stored, workspace  # noqa: F401

ORDER_TYPES = tuple(k for k, v in schemas.ROUTES.items() if v == "order_events")


def routed(rows: DataFrame) -> DataFrame:
    """Add the target table of each row and the default source of order events.

    Rows of unknown type get a NULL table.
    """
    table = F.lit(None).cast("string")
    for event_type, home in schemas.ROUTES.items():
        table = F.when(F.col("event_type") == event_type, F.lit(home)).otherwise(table)
    source = F.col("source") if "source" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("source", F.when(F.col("event_type").isin(*ORDER_TYPES), F.coalesce(source, F.lit("synth")))
                           .otherwise(source)).withColumn("target", table)


def append_events(rows: DataFrame, root: str, batch: str | None = None) -> None:
    """Append envelope rows to their tables, all of them in one commit.

    The rows of a batch lie under ``<table>/batch=<name>-<attempt>/event_type=...``, so each silver reader prunes to its
    own rows.  Columns are conformed to the declared schema; unknown types go to a ``quarantine`` table instead of being
    dropped.  The rows are worked out once and stored; only tables that get rows are written.  Nothing is visible to
    :func:`read_events` before the commit, which names the folders of all tables; a batch that is run again under the same
    name replaces its own rows, whether its first run was finished or not.
    """
    spark = rows.sparkSession
    files = Files(spark, root)
    name = batch if batch is not None else uuid.uuid4().hex
    attempt = 1 + max([_attempt(n)[1] for n in files.names("commits") if _attempt(n)[0] == name], default=0)
    folder = f"batch={name}-{uuid.uuid4().hex[:8]}"
    tagged = stored(routed(rows), "append")
    have = set(tagged.columns)
    hit = {r["target"] for r in tagged.select("target").distinct().collect()}  # at most one row for each table
    for table, schema in schemas.ENVELOPES.items():
        if table not in hit:
            continue
        cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        tagged.filter(F.col("target") == table).select(*cols).write.partitionBy("event_type").parquet(
            f"{root}/{table}/{folder}")
    if None in hit:
        tagged.filter(F.col("target").isNull()).drop("target").write.parquet(f"{root}/quarantine/{folder}")
    files.write_once(f"commits/{name}.{attempt}.json",
                     {"tables": {t or "quarantine": f"{t or 'quarantine'}/{folder}" for t in hit}})


def _attempt(name: str) -> tuple[str, int]:
    """Batch and attempt of a commit's file name; attempt 0 for other files."""
    found = re.fullmatch(r"(.+)\.(\d+)\.json", name)
    return (found[1], int(found[2])) if found else (name, 0)


def committed(spark: SparkSession, root: str, table: str) -> list[str]:
    """Folders of a table, one for each committed batch that gave it rows."""
    files, last = Files(spark, root), {}
    for name in files.names("commits"):
        batch, attempt = _attempt(name)
        if attempt > last.get(batch, ("", 0))[1]:
            last[batch] = (name, attempt)
    folders = [files.read(f"commits/{name}")["tables"].get(table) for name, _ in last.values()]
    return sorted(f"{root}/{f}" for f in folders if f)


def read_events(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Committed rows of an envelope table, or of ``quarantine``; None if there are none."""
    folders = committed(spark, root, table)
    if not folders:
        return None
    reader = spark.read.option("mergeSchema", True) if table == "quarantine" else spark.read.schema(schemas.ENVELOPES[table])
    return reader.option("basePath", f"{root}/{table}").parquet(*folders).drop("batch")


def sweep_events(spark: SparkSession, root: str) -> None:
    """Remove folders of attempts that were not committed or were replaced."""
    files = Files(spark, root)
    for table in (*schemas.ENVELOPES, "quarantine"):
        live = {f.rsplit("/", 1)[1] for f in committed(spark, root, table)}
        for folder in files.names(table):
            if folder not in live:
                files.remove(f"{table}/{folder}")


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Single CSV file with a header, for lists the size of a dimension."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
