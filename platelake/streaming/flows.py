"""Streaming runs of the same silver functions.

A flow is triggered, drains what has been appended and stops; restarting it from
its checkpoint continues where it left off.  Sinks are append-only parquet.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from platelake import schemas
from platelake.operators import telemetry
from platelake.operators.quality import expect_or_drop
from platelake.sources import sinks
from platelake.sources.keyed import ChangeLog

Transform = Callable[[DataFrame], DataFrame]
_LOG = logging.getLogger(__name__)


def triggered_run(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a parquet folder, then stop."""
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_table(spark: SparkSession, stream: DataFrame, transform: Transform, root: str, name: str) -> DataFrame:
    """Run one silver table and read it back."""
    out = f"{root}/{name}"
    triggered_run(transform(stream), out, f"{root}/_checkpoints/{name}")
    return spark.read.parquet(out)


def scd1_stream(spark: SparkSession, changes: DataFrame, keys: list[str], version: str, root: str, gone: str = "false",
                compact_every: int = 20, buckets: int = 16) -> ChangeLog:
    """Follow a change stream into a :class:`ChangeLog` and return it, drained.

    A batch is reduced to its newest change per key and committed as a delta; every ``compact_every`` batches the deltas are
    folded into the base.  Late changes lose against newer ones wherever these are, so the stream itself holds no state.
    A replayed batch replaces its own delta, which changes nothing.
    """
    log = ChangeLog(spark, f"{root}/table", keys, version, gone, buckets)

    def take(df: DataFrame, batch: int) -> None:
        log.append(df, batch)
        if log.pending() >= compact_every:
            log.compact()

    query = (changes.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/_checkpoints/scd1")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return log


def full_refresh(spark: SparkSession, source: Callable[[], DataFrame], transform: Transform, root: str, name: str,
                 attempts: int = 2) -> DataFrame:
    """Rebuild a table from the start under a new checkpoint; one retry of a failed stream, whose error is logged."""
    import uuid

    for attempt in range(1, attempts + 1):
        try:
            return run_table(spark, source(), transform, f"{root}/refresh-{uuid.uuid4().hex}", name)
        except StreamingQueryException as err:
            if attempt == attempts:
                raise
            _LOG.warning("refresh of %s failed, attempt %d: %s", name, attempt, err)
    raise ValueError("attempts must be positive")


def incremental_telemetry(spark: SparkSession, logs: DataFrame, reshape: Transform, root: str,
                          delay: str | None = None, key: str = "trace_id", at: str = "event_ts") -> DataFrame:
    """Telemetry log stream -> order envelope rows, one commit for each batch.

    A retried batch replaces its own rows.  With ``delay`` a record delivered again (the same ``key``) is dropped: it is
    remembered until the watermark, ``delay`` behind the newest time in column ``at``, has passed it by ``delay``, and
    afterwards it is too old to be read.  So state is bounded by the records of twice that time, and ``delay`` must cover
    how late a record may come.
    """
    if delay is not None:
        logs = logs.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return _committed_stream(spark, logs, reshape, root)


def telemetry_stream(spark: SparkSession, logs: DataFrame, spans: DataFrame, unit: DataFrame, root: str,
                     delay: str = "1 hour", reach: str = "2 hours") -> DataFrame:
    """Logs and spans as streams -> order envelope rows; see :func:`telemetry.trace_stream` for what is remembered."""
    def reshape(traces: DataFrame) -> DataFrame:
        return telemetry.events_of(telemetry.order_rows(traces, unit), *telemetry.all_events())

    return _committed_stream(spark, telemetry.trace_stream(logs, spans, delay, reach), reshape, root)


def _committed_stream(spark: SparkSession, rows: DataFrame, reshape: Transform, root: str) -> DataFrame:
    """Reshape each batch and append it in a commit named after the batch; returns the committed order events."""
    out = f"{root}/staging"
    query = (rows.writeStream.foreachBatch(lambda df, batch: sinks.append_events(reshape(df), out, f"telemetry-{batch:09d}"))
             .option("checkpointLocation", f"{root}/_checkpoints/telemetry").trigger(availableNow=True).start())
    query.awaitTermination()
    found = sinks.read_events(spark, out, "order_events")
    return spark.createDataFrame([], schemas.ORDER_EVENTS) if found is None else found


def expected_stream(stream: DataFrame, rules: dict[str, str], flow: str) -> DataFrame:
    """``expect_or_drop`` on a stream; an :class:`ExpectationLog` that listens gets the failures of every batch."""
    failed = [F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()]
    watched = stream.observe(f"{OBSERVED}{flow}", F.count(F.lit(1)).alias(SEEN), *failed)
    return expect_or_drop(watched, rules)


OBSERVED, SEEN = "expect:", "rows_seen"


class ExpectationLog(StreamingQueryListener):
    """Failures per flow, rule and batch, gathered from what the running queries report: no extra pass over the rows.

    ``rows`` is a table of (flow, rule, batch, rows_seen, rows_failed).  A batch that is run again after a failure reports
    again and replaces its figures.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.found = spark, {}

    def __enter__(self) -> "ExpectationLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.wait()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for name, row in (event.progress.observedMetrics or {}).items():
            if name.startswith(OBSERVED):
                figures = row.asDict()
                for rule, failed in figures.items():
                    if rule != SEEN:
                        self.found[name[len(OBSERVED):], rule, event.progress.batchId] = (figures[SEEN], failed)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def wait(self) -> None:
        """Until the reports of finished batches have arrived."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def rows(self) -> DataFrame:
        self.wait()
        return self.spark.createDataFrame([(*key, *figures) for key, figures in sorted(self.found.items())],
                                          "flow string, rule string, batch bigint, rows_seen bigint, rows_failed bigint")
