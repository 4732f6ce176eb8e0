"""Streams: replayed records, late spans, bounded state, expectations of every batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from platelake.operators import quality, telemetry
from platelake.streaming import flows

LOG = "trace_id string, time_unix_nano bigint, attributes map<string,string>"
SPAN = "trace_id string, name string, start_time_unix_nano bigint, attributes map<string,string>"
START = 1_749_686_400
UNIT = [(1, "CA"), (2, "CA"), (3, "NY")]


def nanos(minutes):
    return (START + 60 * minutes) * 1_000_000_000


def log(trace, minutes, user="u1", amount="10.00"):
    return trace, nanos(minutes), {"app.order.amount": amount, "user.id": user}


def order(trace, minutes, prep="600"):
    return trace, telemetry.ORDER_SPAN, nanos(minutes), {"order.store_id": "s1", "order.skus": '["4 x2"]', "order.prep_seconds": prep,
                                                         "order.location.state": "CA"}


def stage(trace, name, minutes):
    return trace, f"stage: {name}", nanos(minutes), {}


class Feed:
    """Two folders of files, and the streams over them, a file at a time."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        self.unit = spark.createDataFrame(UNIT, "unit_id bigint, state string")

    def put(self, kind, rows, schema):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{kind}")

    def stream(self, kind, schema):
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/{kind}")

    def run(self, **more):
        events = flows.telemetry_stream(self.spark, self.stream("logs", LOG), self.stream("spans", SPAN), self.unit,
                                        f"{self.root}/out", **more)
        return events.filter("event_type = 'guest_order'").collect(), events.filter("event_type = 'status_event'").collect()


def test_late_spans_and_replayed_records_count_once(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.put("logs", [log("a", 0), log("b", 1), log("none", 2), log("n", 3, "fee-test-9"), log("zero", 3, amount="0")], LOG)
    feed.put("spans", [order("b", 1), stage("b", "Prep", 2), stage("b", "Prep", 2)], SPAN)
    orders, _ = feed.run()
    assert orders == []  # the watermark has not passed them
    # The spans of "a" come an hour later than its log; records and spans of "b" are delivered once more.
    feed.put("spans", [order("a", 50, "2400"), stage("a", "Delivered", 55), stage("b", "Prep", 2)], SPAN)
    feed.put("logs", [log("b", 1), log("b", 1)], LOG)
    feed.run()
    feed.put("logs", [log("end", 60 * 24 * 3, "fee-test")], LOG)
    feed.put("spans", [order("end", 60 * 24 * 3)], SPAN)
    orders, states = feed.run()
    breach = {r.guest_order_id: r.sos_breach for r in orders}
    ids = {t: r[0] for t in ("a", "b", "none") for r in spark.range(1).select(telemetry.make_id("otel", F.lit(t))).collect()}
    assert sorted(breach) == sorted(ids.values()) and breach[ids["a"]] and not breach[ids["b"]]
    seen = {t: sorted(s.current_state for s in states if s.guest_order_id == i) for t, i in ids.items()}
    assert seen == {"a": ["fulfilled"], "b": ["preparing"], "none": ["fulfilled", "preparing", "ready"]}
    assert len({s.status_event_id for s in states}) == len(states)


def test_same_orders_as_the_batch_job(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    logs = [log(f"t{i}", i, amount=f"{5 + i}.25") for i in range(60)]
    spans = [order(f"t{i}", i, str(300 * (i % 9))) for i in range(60) if i % 4] + [stage(f"t{i}", "Bake", i + 1) for i in range(60) if i % 3]
    for at in range(0, 60, 15):
        feed.put("logs", logs[at:at + 15], LOG)
    feed.put("spans", spans[::2], SPAN)
    feed.put("spans", spans[1::2], SPAN)
    feed.put("logs", [log("end", 60 * 24 * 3, "fee-test")], LOG)
    feed.put("spans", [order("end", 60 * 24 * 3)], SPAN)
    events = flows.telemetry_stream(spark, feed.stream("logs", LOG), feed.stream("spans", SPAN), feed.unit, f"{feed.root}/out")
    batch = telemetry.reshape_orders(spark.createDataFrame(logs, LOG), spark.createDataFrame(spans, SPAN), feed.unit)
    cols = batch.columns
    assert sorted(events.select(cols).collect(), key=str) == sorted(batch.collect(), key=str)


def test_state_is_bounded_and_spans_are_not_read_again(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    for day in range(6):
        feed.put("logs", [log(f"d{day}-{i}", day * 1440 + i) for i in range(40)], LOG)
        feed.put("spans", [order(f"d{day}-{i}", day * 1440 + i) for i in range(40)], SPAN)
    traces = telemetry.trace_stream(feed.stream("logs", LOG), feed.stream("spans", SPAN), "1 hour", "2 hours")
    assert traces.isStreaming
    query = (traces.writeStream.foreachBatch(lambda df, n: df.write.format("noop").mode("append").save()).option("checkpointLocation", f"{feed.root}/c")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = [sum(op.numRowsTotal for op in p.stateOperators) for p in query.recentProgress]
    assert max(rows[-3:]) <= max(rows[:3]) + 10 < 4 * 6 * 40  # a day's records and spans in the operators, not six days'
    # Every file is read in one batch; no scan of all spans joins in.
    assert sum(p.numInputRows for p in query.recentProgress) == 6 * 80


def test_replayed_records_across_files(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    logs = [(*log(f"t{i}", i), datetime(2025, 6, 12) + timedelta(minutes=i)) for i in range(30)]
    schema = LOG + ", event_ts timestamp"
    for _ in range(2):
        feed.put("logs", logs, schema)
    spans = spark.createDataFrame([order(f"t{i}", i) for i in range(30)], SPAN)
    run = lambda root, delay: flows.incremental_telemetry(
        spark, feed.stream("logs", schema), lambda df: telemetry.reshape_orders(df, spans, feed.unit), f"{feed.root}/{root}", delay)
    assert run("once", "1 day").filter("event_type = 'guest_order'").count() == 30
    assert run("twice", None).filter("event_type = 'guest_order'").count() == 60


def test_record_time_is_its_text_first(spark):
    rows = [("a", 0, {"app.order.amount": "1"}, "2025-06-12 10:00:00"), ("b", nanos(0), {"app.order.amount": "1"}, "junk"),
            ("c", nanos(0), {"app.order.amount": "1"}, None), ("d", None, {"app.order.amount": "1"}, None)]
    logs = spark.createDataFrame(rows, LOG + ", event_ts string")
    got = {r.trace_id: r.event_ts for r in telemetry.logs_scan(logs).collect()}
    assert got == {"a": datetime(2025, 6, 12, 10), "b": datetime(2025, 6, 12), "c": datetime(2025, 6, 12)}
    since = F.lit("2025-06-12 05:00:00").cast("timestamp")
    assert [r.trace_id for r in telemetry.logs_scan(logs, since).collect()] == ["a"]


def test_a_stage_sent_twice_is_one_event(spark):
    unit = spark.createDataFrame(UNIT, "unit_id bigint, state string")
    spans = spark.createDataFrame([order("a", 0), stage("a", "Prep", 1), stage("a", "Prep", 1), stage("a", "Bake", 2)], SPAN)
    out = telemetry.reshape_orders(spark.createDataFrame([log("a", 0)], LOG), spans, unit).filter("event_type = 'status_event'").collect()
    assert len(out) == 2 and len({r.status_event_id for r in out}) == 2


def test_expectations_of_every_batch(spark, tmp_path):
    schema = "id int, amount double"
    batches = [[(1, 5.0), (2, None), (3, -1.0)], [(4, 2.0)], [(None, 1.0), (6, -2.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rules = {"has_id": "id IS NOT NULL", "positive": "amount > 0"}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with flows.ExpectationLog(spark) as found:
        flows.triggered_run(flows.expected_stream(stream, rules, "payments"), f"{tmp_path}/out", f"{tmp_path}/c")
    per = {(r.rule, r.batch): (r.rows_seen, r.rows_failed) for r in found.rows().collect()}
    for n, rows in enumerate(batches):
        for r in quality.failed_counts(spark.createDataFrame(rows, schema), rules).collect():
            assert per[r.rule, n] == (r.rows_seen, r.rows_failed)
    assert {r.flow for r in found.rows().collect()} == {"payments"}
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 4]
    assert flows.ExpectationLog(spark).rows().count() == 0


@pytest.mark.parametrize("delay", ["1 hour"])
def test_streams_of_empty_folders(spark, tmp_path, delay):
    feed = Feed(spark, tmp_path)
    feed.put("logs", [], LOG)
    feed.put("spans", [], SPAN)
    assert feed.run(delay=delay) == ([], [])
