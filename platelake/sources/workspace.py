"""The shared folder for intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it; where that is unset the SQL warehouse is used.  A warehouse on a local disk is
    accepted only with a local master, since executors on other machines would not see the files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local_disk = home.startswith(("file:", "/"))
    if local_disk and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{home}/_work"


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name in the workspace."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the workspace and read them back, so that their lineage ends there.

    Python stages on the way get batches of ``BATCH_ROWS`` rows, which bounds what a worker holds of long texts.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    _WRITTEN.append(path)
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


RELEASE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL_ROWS, SMALL_BYTES = 200_000, 8 << 20


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored``; the shuffle files of the step go with its end, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(RELEASE_SETTING, "false")
    spark.conf.set(RELEASE_SETTING, "true")
    try:
        return stored(df, name)
    finally:
        spark.conf.set(RELEASE_SETTING, before)


def lookup(df: DataFrame, name: str) -> DataFrame:
    """``settled``, and marked for broadcast where its rows and bytes, as counted, are few.

    The planner alone would size it too late: by then it has shuffled the large side of a join.
    """
    rows = settled(df, name)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(rows) if size <= SMALL_BYTES and rows.count() <= SMALL_ROWS else rows


def clear(spark: SparkSession) -> int:
    """Remove what ``stored`` has written in this process; call it once the results that read it are written themselves.

    Returns the number of folders.
    """
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done += 1
    return done
