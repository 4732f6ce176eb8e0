"""Ingestion, enrichment, telemetry and derivation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platelake import schemas
from platelake.functions import weather as wx
from platelake.functions.ids import make_id
from platelake.operators import derive, enrich, gold, silver, telemetry
from platelake.plans import payload_feeds
from platelake.plans.catalog import GIVEN, Tables, profile_events
from platelake.plans.duck import HU, I, KIND, NOW_ORD, RISK, S, TODAY, cases, fx, mid, sha
from platelake.plans.registry import query
from platelake.sources import envelope, payloads, sinks
from platelake.sources.keyed import ChangeLog, KeyedTable
from platelake.streaming import flows, refresh

# ---- sources
query("dim_lookup", "SELECT unit_id, franchisee_id, region_id FROM unit")(lambda t: envelope.lookup(t.unit))
query("gold_batch_read", f"""SELECT unit_id, {S('daily_revenue')} revenue, count(*) AS days FROM unit_performance_daily
      GROUP BY 1""")(lambda t: stored(t, gold.unit_performance_daily(t.guest_order)).groupBy("unit_id").agg(
          (F.sum(F.floor(F.col("daily_revenue") * 10000 + F.lit(0.5))) / F.lit(10000)).alias("revenue"),
          F.count(F.lit(1)).alias("days")))
query("otel_logs_scan", "SELECT * EXCLUDE (user_id), CAST(NULL AS DOUBLE) shipping_amount, user_id FROM otel_logs WHERE amount>0".replace(
    "* EXCLUDE (user_id)", "trace_id, time_unix_nano, event_ts, order_id, CASE WHEN member_id IS NOT NULL THEN ' '||member_id END member_id, amount, items_count, tracking_id"),
    ("event_ts",))(lambda t: telemetry.logs_scan(t.otel_logs))
query("otel_logs_since", """SELECT trace_id, event_ts FROM otel_logs WHERE amount>0
      AND event_ts>(SELECT max(ts) FROM events)-INTERVAL 5 DAY""", ("event_ts",))(
    lambda t: telemetry.logs_scan(t.otel_logs, t.event_clock - F.expr("INTERVAL 5 DAYS")).select("trace_id", "event_ts"))
query("otel_spans_scan", """SELECT trace_id, 'order-tracker received order' AS name, store_id, channel, prep_seconds, state, sos_target
      FROM order_span WHERE trace_id IN (SELECT trace_id FROM otel_logs WHERE amount>0) UNION ALL
      SELECT trace_id, 'stage: '||stage, NULL, NULL, NULL, NULL, NULL FROM stage_span
      WHERE trace_id IN (SELECT trace_id FROM otel_logs WHERE amount>0)""")(
    lambda t: telemetry.spans_scan(t.otel_spans, telemetry.logs_scan(t.otel_logs)).select(
        "trace_id", "name", "store_id", "channel", "prep_seconds", "state", "sos_target"))
query("ts_from_nanos", "SELECT trace_id, event_ts FROM otel_logs", ("event_ts",))(
    lambda t: t.otel_logs.select("trace_id", telemetry.from_nanos(F.col("time_unix_nano")).alias("event_ts")))
query("otel_event_time", """SELECT trace_id, CASE WHEN CAST(trace_id AS BIGINT)%3=0 THEN event_ts+INTERVAL 1 HOUR ELSE event_ts END event_ts
      FROM otel_logs""", ("event_ts",))(lambda t: t.otel_logs.select("trace_id", telemetry.event_time(told_time(), F.col("time_unix_nano")).alias(
          "event_ts")))
query("high_water_mark", "SELECT max(event_ts) high_water_mark FROM otel_base", ("high_water_mark",))(
    lambda t: envelope.high_water_mark(reshaped(t)))
query("resume_point", f"""SELECT date_trunc('hour',greatest({NOW_ORD},(SELECT max(ts) FROM events),
      (SELECT max(logged_at) FROM waste_log),(SELECT max(snapshot_at) FROM on_hand_balance),
      (SELECT max(created_at) FROM receiving_order)))+INTERVAL 1 HOUR resume_at""", ("resume_at",))(
    lambda t: envelope.resume_point(*[t.envelope(e) for e in ("order_events", "inventory_events", "guest_events",
                                                              "loyalty_events", "workforce_events")]))
query("weather_json_scan", "SELECT * FROM daily_weather", ("forecast_date",))(
    lambda t: payloads.forecast(payload_feeds.forecasts(t), t.today))
LEVEL = """CASE WHEN lower(event) LIKE '%warning%' THEN 'warning' WHEN lower(event) LIKE '%watch%' THEN 'watch'
      WHEN lower(event) LIKE '%advisory%' THEN 'advisory' END"""
query("alerts_json_scan", f"""SELECT state, event, onset_date||'T06:00:00Z' onset, expires_date||'T18:00:00Z' expires,
      {LEVEL} alert_level FROM alert_feed WHERE {LEVEL} IS NOT NULL""")(lambda t: payloads.alerts(payload_feeds.alerts(t)))
query("holidays_json_scan", f"""SELECT state, event_date, substr({sha("'nager'", 'event_date', 'event_name')},1,16) event_id,
      event_name, 'national_holiday' event_category, '' venue, CAST(0 AS BIGINT) est_attendance, source
      FROM happening_feed WHERE source='nager' AND report_id%3<>1""", ("event_date",))(
    lambda t: payloads.holidays(payload_feeds.holidays(t)))
EVENT_ID = f"substr({sha('source', 'metro_area', 'event_date', 'event_name')},1,16) event_id"
query("ticketmaster_json_scan", f"""SELECT metro_area, event_date, {EVENT_ID}, event_name,
      CASE WHEN crowd%2=1 THEN 'major_sports' ELSE 'concert' END event_category, venue,
      CAST(CASE WHEN crowd=9 THEN 5000 ELSE crowd END*1000 AS BIGINT) est_attendance, source FROM happening_feed
      WHERE source='ticketmaster'""", ("event_date",))(lambda t: payloads.ticketmaster(payload_feeds.tickets(t)))
query("seatgeek_json_scan", f"""SELECT metro_area, event_date, {EVENT_ID}, event_name,
      CASE WHEN {KIND} IN ('concert','theater') THEN 'concert' ELSE 'major_sports' END event_category, venue,
      CAST(15000 AS BIGINT) est_attendance, source FROM happening_feed WHERE source='seatgeek'
      AND {KIND} NOT IN ('circus','comedy')""", ("event_date",))(lambda t: payloads.seatgeek(payload_feeds.seats(t)))


def told_time():
    """A record's own time text: an hour later, junk, or none."""
    n = F.col("trace_id").cast("bigint") % 3
    later = telemetry.from_nanos(F.col("time_unix_nano")) + F.expr("INTERVAL 1 HOUR")
    return F.when(n == 0, later.cast("string")).when(n == 1, F.lit("soon"))


def reshaped(t):
    return telemetry.reshape_orders(t.otel_logs, t.otel_spans, t.unit)


def stored(t, df):
    """Write a frame to the workspace and read it back as a table."""
    path = sinks.fresh(t.spark, "table")
    sinks.overwrite(df, path)
    return envelope.read_batch(t.spark, path)


# ---- sinks
query("append_evolving", """SELECT 'order_events' target, 'payment' event_type, count(*) AS rows, 'synth' source FROM payment
      UNION ALL SELECT 'workforce_events', 'shift', count(*), NULL FROM shift
      UNION ALL SELECT 'quarantine', event_type, count(*), NULL FROM events GROUP BY event_type""")(
    lambda t: append_evolving(t))
query("append_otel", """SELECT 'guest_order' event_type, count(*) AS rows FROM otel_base UNION ALL
      SELECT 'order_item', count(*) FROM otel_line UNION ALL SELECT 'payment', count(*) FROM otel_base UNION ALL
      SELECT 'delivery_order', count(*) FROM otel_base WHERE channel='own_delivery' UNION ALL
      SELECT 'status_event', CAST(sum(CASE WHEN stages>0 THEN stages ELSE 3 END) AS BIGINT) FROM otel_base""")(
    lambda t: append_otel(t))
query("overwrite_dim", "SELECT * FROM menu_item")(lambda t: overwrite_dim(t))
query("export_csv", "SELECT CAST(menu_item_id AS VARCHAR) menu_item_id, item_name, category FROM menu_item")(
    lambda t: export_csv(t, t.menu_item.select("menu_item_id", "item_name", "category")))
query("export_csv_stores", "SELECT CAST(unit_id AS VARCHAR) unit_id, unit_name, metro_area FROM unit")(
    lambda t: export_csv(t, t.unit.select("unit_id", "unit_name", "metro_area")))
query("merge_weather", """SELECT metro_area, forecast_date, observation_id, high_temp_f FROM weather_feed QUALIFY row_number() OVER
      (PARTITION BY metro_area, forecast_date ORDER BY observation_id%2 DESC, observation_id DESC)=1""", ("forecast_date",))(
    lambda t: merge_weather(t))
query("merge_events", """SELECT event_id, event_name, report_id FROM event_report QUALIFY row_number() OVER
      (PARTITION BY event_id ORDER BY report_id%2 DESC, report_id DESC)=1""")(lambda t: merge_events(t))
query("write_feature_table", """SELECT profile_id, CASE WHEN profile_id%3=0 THEN -1 ELSE recency_days END recency_days, tier
      FROM customer_features""")(lambda t: write_feature_table(t))


def append_evolving(t):
    root = sinks.fresh(t.spark, "staging")
    sinks.append_events(t.events_of("payment").drop("source"), root)
    sinks.append_events(t.events_of("shift"), root)
    sinks.append_events(t.raw("events"), root)
    count = F.count(F.lit(1)).alias("rows")
    parts = [sinks.read_events(t.spark, root, name).select(
        F.lit(name).alias("target"), "event_type", F.col("source") if name == "order_events" else
        F.lit(None).cast("string").alias("source")).groupBy("target", "event_type", "source").agg(count)
        for name in ("order_events", "workforce_events", "quarantine")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def append_otel(t):
    root = sinks.fresh(t.spark, "staging")
    sinks.append_events(reshaped(t), root)
    return sinks.read_events(t.spark, root, "order_events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def export_csv(t, rows):
    path = sinks.fresh(t.spark, "export")
    sinks.export_csv(rows, path)
    return t.spark.read.option("header", True).csv(path)


def _two_batches(t, df, keys, version):
    """First the even versions, then the odd ones, into a keyed table."""
    table = KeyedTable(t.spark, sinks.fresh(t.spark, "keyed"), keys)
    for odd in (0, 1):
        batch = silver.latest(df.filter(F.col(version) % 2 == odd), keys, version)
        table.upsert(batch, version)
    return table.read()


def merge_weather(t):
    rows = t.weather_feed.select("metro_area", "forecast_date", "observation_id", "high_temp_f")
    return _two_batches(t, rows, ["metro_area", "forecast_date"], "observation_id")


def merge_events(t):
    rows = payload_feeds.event_rows(t.happening_feed).select("event_id", "event_name", "report_id")
    return _two_batches(t, rows, ["event_id"], "report_id")


def write_feature_table(t):
    table = KeyedTable(t.spark, sinks.fresh(t.spark, "features"), ["profile_id"])
    first = table.upsert(t.customer_features.select("profile_id", "recency_days", "tier"))
    table.upsert(first.filter(F.col("profile_id") % 3 == 0).withColumn("recency_days", F.lit(-1)))
    return table.read()


def overwrite_dim(t):
    """The dimension replaced by itself with one column more, then as it is."""
    table = KeyedTable(t.spark, sinks.fresh(t.spark, "dimension"), ["menu_item_id"], buckets=4)
    table.replace(t.menu_item.withColumn("old", F.lit(1)))
    return table.replace(t.menu_item)


# ---- streaming

class Streamed(Tables):
    """The same tables with user events arriving as a stream of appended files."""

    def raw(self, name):
        if name != "events":
            return super().raw(name)
        # The wildcard also covers a table that is a single file.
        return envelope.read_stream(self.spark, self.path("events") + "*", GIVEN["events"]).withColumn(
            "ts", F.col("ts").cast("timestamp"))


def _root(t):
    return sinks.fresh(t.spark, "stream")


def streamed(t, event_type, transform):
    """Append the events to their envelope table, then run one silver table over it as a stream."""
    root, home = _root(t), schemas.ROUTES[event_type]
    sinks.append_events(t.events_of(event_type), f"{root}/staging")
    stream = envelope.read_stream(t.spark, f"{root}/staging/{home}", schemas.ENVELOPES[home])
    return flows.run_table(t.spark, stream, transform, root, event_type)


def streamed_orders(t):
    return streamed(t, "guest_order", lambda s: silver.guest_order(s, t.unit, "event_ts"))


query("stream_envelope", "SELECT event_id, user_id, event_type, value FROM events")(
    lambda t: flows.run_table(t.spark, Streamed(t.spark, t.dir).raw("events"),
                              lambda s: s.select("event_id", "user_id", "event_type", "value"), _root(t), "events"))
query("stream_static_join", "SELECT * FROM time_punch", ("punch_in", "punch_out", "created_at"))(
    lambda t: flows.run_table(t.spark, Streamed(t.spark, t.dir).events_of("time_punch"),
                              lambda s: silver.time_punch(s, t.unit, "event_ts"), _root(t), "time_punch"))
query("stream_digital_account", "SELECT * FROM digital_account", ("created_at",))(
    lambda t: flows.run_table(t.spark, profile_events(Streamed(t.spark, t.dir).raw("events")),
                              lambda s: silver.digital_account(s, "event_ts"), _root(t), "digital_account"))
query("scd1_stream", "SELECT * EXCLUDE (digital_account_id) FROM guest_profile", ("created_at",))(
    lambda t: flows.scd1_stream(t.spark, silver.guest_profile_changes(
        profile_events(Streamed(t.spark, t.dir).raw("events")), t.unit), ["guest_profile_id"], "created_at", _root(t)).read())
query("scd1_compacted", "SELECT * EXCLUDE (digital_account_id) FROM guest_profile WHERE guest_profile_id%7<>0", ("created_at",))(
    lambda t: compacted_profiles(t))
query("stream_guest_order", "SELECT * EXCLUDE (prep) FROM guest_order",
      ("placed_at", "ready_at", "fulfilled_at", "cancelled_at", "created_at"))(lambda t: streamed_orders(t))
query("stream_order_item", "SELECT * FROM order_item", ("placed_at", "created_at"))(
    lambda t: streamed(t, "order_item", lambda s: silver.order_item(s, "event_ts")))
query("stream_gold_daily", "SELECT * FROM unit_performance_daily", ("date",))(
    lambda t: gold.unit_performance_daily(streamed_orders(t)))


def compacted_profiles(t):
    """The change feed in three batches, the newest first, erasures of every seventh profile, all folded into the base."""
    changes = silver.guest_profile_changes(profile_events(t.raw("events")), t.unit)
    log = ChangeLog(t.spark, sinks.fresh(t.spark, "profiles"), ["guest_profile_id"], "created_at", "erased", buckets=8)
    rows = changes.withColumn("erased", F.lit(False))
    gone = changes.filter(F.col("guest_profile_id") % 7 == 0).withColumns(
        {"created_at": F.lit("2100-01-01").cast("timestamp"), "erased": F.lit(True)})
    log.append(rows.filter(F.dayofmonth("created_at") > 20), 0)
    log.append(gone, 1)
    log.compact()
    log.append(rows.filter(F.dayofmonth("created_at") <= 10), 2)
    log.append(rows.filter(F.dayofmonth("created_at").between(11, 20)), 3)
    log.compact()
    return log.read().drop("erased")


query("full_refresh", "SELECT * FROM shift", ("shift_start", "shift_end", "created_at"))(
    lambda t: flows.full_refresh(t.spark, lambda: Streamed(t.spark, t.dir).events_of("shift"),
                                 lambda s: silver.shift(s, "event_ts"), _root(t), "shift"))
query("incremental_refresh", """SELECT event_type, count(*) AS rows FROM (SELECT 'guest_order' event_type FROM otel_base
      UNION ALL SELECT 'order_item' FROM otel_line UNION ALL SELECT 'payment' FROM otel_base UNION ALL
      SELECT 'delivery_order' FROM otel_base WHERE channel='own_delivery' UNION ALL
      SELECT 'status_event' FROM otel_base, range(CASE WHEN stages>0 THEN stages ELSE 3 END)) GROUP BY 1""")(
    lambda t: flows.incremental_telemetry(
        t.spark, Streamed(t.spark, t.dir).otel_logs,
        lambda logs: telemetry.reshape_orders(logs, t.otel_spans, t.unit), _root(t)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows")))

OTEL_COUNTS = """SELECT event_type, count(*) AS rows FROM (SELECT 'guest_order' event_type FROM otel_base
      UNION ALL SELECT 'order_item' FROM otel_line UNION ALL SELECT 'payment' FROM otel_base UNION ALL
      SELECT 'delivery_order' FROM otel_base WHERE channel='own_delivery' UNION ALL
      SELECT 'status_event' FROM otel_base, range(CASE WHEN stages>0 THEN stages ELSE 3 END)) GROUP BY 1"""
query("incremental_refresh_replayed", OTEL_COUNTS)(lambda t: replayed(t))
query("telemetry_streamed", "SELECT trace_id, guest_order_id, unit_id, channel, cents/100.0::DOUBLE total_amount, breach sos_breach FROM otel_base")(
    lambda t: telemetry_streamed(t))
query("expect_stream", """SELECT 'user_events' flow, unnest([{'rule':'has_value','rows_seen':n,'rows_failed':a},
      {'rule':'own_user','rows_seen':n,'rows_failed':b}], recursive:=true) FROM (SELECT count(*) n, count(*) FILTER (WHERE NOT value>5) a,
      count(*) FILTER (WHERE NOT user_id%10<>0) b FROM events)""")(lambda t: expected_events(t))


def _files(t, df, path, times=1):
    """Append the rows to a folder as one file, ``times`` times, and return its schema."""
    for _ in range(times):
        df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def _one_by_one(t, path, schema):
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def replayed(t):
    """Every log record is delivered in two files."""
    root = _root(t)
    logs = t.otel_logs.withColumn("event_ts", telemetry.from_nanos(F.col("time_unix_nano")))
    stream = _one_by_one(t, f"{root}/logs", _files(t, logs, f"{root}/logs", 2))
    return flows.incremental_telemetry(
        t.spark, stream, lambda df: telemetry.reshape_orders(df, t.otel_spans, t.unit), root, delay="60 days").groupBy(
        "event_type").agg(F.count(F.lit(1)).alias("rows"))


def telemetry_streamed(t):
    """Logs and spans as two streams; a closing record in each moves the watermark past the last order."""
    root = _root(t)
    end = t.otel_logs.agg(F.max("time_unix_nano") + F.lit(20 * 86_400_000_000_000)).scalar()
    last_log = t.otel_logs.limit(1).select(
        F.lit("close").alias("trace_id"), end.alias("time_unix_nano"),
        F.create_map(F.lit("app.order.amount"), F.lit("1"), F.lit("user.id"), F.lit("fee-test")).alias("attributes"))
    last_span = t.otel_spans.limit(1).select(F.lit("close").alias("trace_id"), F.lit(telemetry.ORDER_SPAN).alias("name"),
                                             end.alias("start_time_unix_nano"), "attributes")
    for name, rows, last in (("logs", t.otel_logs, last_log), ("spans", t.otel_spans, last_span)):
        _files(t, rows.select(last.columns), f"{root}/{name}")
        _files(t, last, f"{root}/{name}")
    events = flows.telemetry_stream(t.spark, _one_by_one(t, f"{root}/logs", last_log.schema),
                                    _one_by_one(t, f"{root}/spans", last_span.schema), t.unit, root)
    traces = t.otel_logs.select("trace_id", make_id("otel", F.col("trace_id")).alias("guest_order_id"))
    return events.filter(F.col("event_type") == "guest_order").join(traces, "guest_order_id").select(
        "trace_id", "guest_order_id", "unit_id", "channel", "total_amount", "sos_breach")


def expected_events(t):
    """User events as a stream under two rules; the failures that its batches reported, added up."""
    rules = {"has_value": "value > 5", "own_user": "user_id % 10 <> 0"}
    root = _root(t)
    stream = flows.expected_stream(Streamed(t.spark, t.dir).raw("events"), rules, "user_events")
    with flows.ExpectationLog(t.spark) as log:
        flows.triggered_run(stream, f"{root}/events", f"{root}/_checkpoints/events")
    return log.rows().groupBy("flow", "rule").agg(F.sum("rows_seen").alias("rows_seen"), F.sum("rows_failed").alias("rows_failed"))


# ---- telemetry reshape
ITEMS = "FROM otel_line"
query("parse_skus", """SELECT trace_id, m menu_item_id, q quantity FROM (SELECT trace_id, m0 m, q0 q FROM order_span WHERE m0 IS NOT NULL
      UNION ALL SELECT trace_id, m1, q1 FROM order_span WHERE m0 IS NOT NULL) WHERE q>0 AND m>0""")(
    lambda t: t.otel_spans.filter(F.col("name") == telemetry.ORDER_SPAN).select(
        "trace_id", F.explode(telemetry.parse_skus(F.col("attributes")["order.skus"])).alias("s")).select("trace_id", "s.*"))
query("parse_member_id", "SELECT trace_id, CASE WHEN member_id>0 THEN member_id END member_id FROM otel_logs")(
    lambda t: t.otel_logs.select("trace_id", telemetry.parse_member_id(F.col("attributes")["app.order.member_id"]).alias("member_id")))
query("filter_noise", """SELECT trace_id FROM otel_logs WHERE amount>0 AND user_id NOT LIKE 'fee-test%'
      AND user_id NOT LIKE 'c2-verify%'""")(
    lambda t: telemetry.logs_scan(t.otel_logs).filter(~telemetry.is_noise(F.col("user_id"))).select("trace_id"))
query("index_spans", """SELECT trace_id, store_id, channel, (SELECT count(*) FROM stage_span s WHERE s.trace_id=o.trace_id) stage_count
      FROM (SELECT DISTINCT trace_id FROM (SELECT trace_id FROM order_span UNION ALL SELECT trace_id FROM stage_span)) o
      LEFT JOIN order_span USING (trace_id) WHERE trace_id IN (SELECT trace_id FROM otel_logs WHERE amount>0)""")(
    lambda t: telemetry.index_spans(telemetry.spans_scan(t.otel_spans, telemetry.logs_scan(t.otel_logs))).select(
        "trace_id", "span.store_id", "span.channel", "stage_count"))
query("map_store_to_unit", "SELECT trace_id, unit_id FROM otel_base")(lambda t: base(t).select("trace_id", "unit_id"))
query("otel_guest_order", "SELECT * FROM otel_order", ("placed_at",))(
    lambda t: telemetry.events_of(base(t), telemetry.order_events()).select(
        "guest_order_id", "unit_id", "channel", "order_type", "order_status", "profile_id", "member_id", "subtotal",
        "discount_amount", "tax_amount", "total_amount", "placed_at", "sos_breach"))
query("otel_order_item", "SELECT * FROM otel_line")(lambda t: telemetry.events_of(base(t), telemetry.item_events()).select(
    "order_item_id", "guest_order_id", "unit_id", "menu_item_id", "quantity", "unit_price", "line_net_amount"))
query("unit_price_floor", "SELECT min(unit_price) lowest_price, count(*) FILTER (WHERE unit_price<0.01) below_floor FROM otel_line")(
    lambda t: telemetry.events_of(base(t), telemetry.item_events()).agg(F.min("unit_price").alias("lowest_price"),
                                                     F.count_if(F.col("unit_price") < 0.01).alias("below_floor")))
query("otel_payment", f"""SELECT {mid("'otel-pay'", 'trace_id')} payment_id, guest_order_id, unit_id, 'card' tender_type,
      cents/100.0::DOUBLE amount, CAST(CAST(event_ts AS DATE) AS VARCHAR) settlement_date FROM otel_base""")(
    lambda t: telemetry.events_of(base(t), telemetry.payment_events()).select("payment_id", "guest_order_id", "unit_id", "tender_type", "amount",
                                                     "settlement_date"))
query("otel_status_event", f"""SELECT {mid("'otel-status'", 'trace_id', 'part')} status_event_id, guest_order_id, prior_state,
      current_state, prep elapsed_seconds_in_prior_state, target sos_target_seconds, breach AND current_state='ready' is_sos_breach
      FROM (SELECT b.*, 'placed' prior_state, CASE part WHEN 'outfordelivery' THEN 'ready' WHEN 'delivered' THEN 'fulfilled'
      ELSE 'preparing' END current_state, part FROM otel_base b JOIN (SELECT trace_id, lower(replace(stage,' ','')) part
      FROM stage_span) USING (trace_id) UNION ALL SELECT b.*, p, c, p FROM otel_base b, (VALUES ('placed','preparing'),
      ('preparing','ready'),('ready','fulfilled')) v(p,c) WHERE stages=0)""")(
    lambda t: telemetry.events_of(base(t), telemetry.status_events()).select(
        "status_event_id", "guest_order_id", "prior_state", "current_state", "elapsed_seconds_in_prior_state",
        "sos_target_seconds", "is_sos_breach"))
query("otel_delivery_order", f"""SELECT {mid("'otel-deliv'", 'trace_id')} delivery_order_id, guest_order_id,
      tracking_id platform_order_reference, prep+900 estimated_delivery_seconds, prep+900 actual_delivery_seconds
      FROM otel_base WHERE channel='own_delivery'""")(
    lambda t: telemetry.events_of(base(t), telemetry.delivery_events()).select(
        "delivery_order_id", "guest_order_id", "platform_order_reference", "estimated_delivery_seconds",
        "actual_delivery_seconds"))
query("reshape_orders", f"""SELECT event_type, count(*) AS rows, {I('amount')} amount FROM (
      SELECT 'guest_order' event_type, cents amount FROM otel_base UNION ALL SELECT 'payment', cents FROM otel_base UNION ALL
      SELECT 'order_item', {fx('line_net_amount', 100)} FROM otel_line UNION ALL
      SELECT 'delivery_order', NULL FROM otel_base WHERE channel='own_delivery' UNION ALL
      SELECT 'status_event', NULL FROM otel_base, range(CASE WHEN stages>0 THEN stages ELSE 3 END)) GROUP BY 1""")(
    lambda t: reshaped(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.floor(F.coalesce(
        "total_amount", "amount", "line_net_amount") * 100 + F.lit(0.5))).alias("amount")))


def base(t):
    return telemetry.order_base(t.otel_logs, t.otel_spans, t.unit)


# ---- weather and events
query("wmo_condition", "SELECT observation_id, " + "CASE " + " ".join(
    f"WHEN weather_code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in wx.WMO_RANGES) + " ELSE 'clear' END weather_condition FROM weather_feed")(
    lambda t: t.weather_feed.select("observation_id", wx.wmo_condition(F.col("weather_code")).alias("weather_condition")))
query("temperature_override", "SELECT metro_area, forecast_date, observation_type, weather_condition FROM daily_weather", ("forecast_date",))(
    lambda t: t.daily_weather.select("metro_area", "forecast_date", "observation_type", "weather_condition"))
query("classify_alert", f"SELECT alert_id, {LEVEL} alert_level FROM alert_feed")(
    lambda t: t.alert_feed.select("alert_id", wx.classify_alert(F.col("event")).alias("alert_level")))
query("metro_centroids", "SELECT metro_area, state, avg(lat) lat, avg(lon) lon FROM unit GROUP BY 1,2")(
    lambda t: enrich.metro_centroids(t.unit))
query("apply_alerts", "SELECT metro_area, forecast_date, alert_level FROM weather_alerted", ("forecast_date",))(
    lambda t: enrich.apply_alerts(t.daily_weather, enrich.classified_alerts(t.alert_feed), t.unit).select(
        "metro_area", "forecast_date", "alert_level"))
query("weather_multiplier", "SELECT * FROM weather_conditions", ("forecast_date",))(lambda t: t.weather_conditions)
query("event_multiplier", "SELECT report_id, event_category, est_demand_multiplier FROM event_report")(
    lambda t: payload_feeds.event_rows(t.happening_feed).select("report_id", "event_category", "est_demand_multiplier"))
query("compose_multipliers", """SELECT metro_area, forecast_date, event_id, round(least(2.5::DOUBLE,greatest(0.3::DOUBLE,
      coalesce(demand_multiplier,1.0)*coalesce(est_demand_multiplier,1.0))),4) multiplier FROM weather_conditions w
      LEFT JOIN (SELECT metro_area, event_date forecast_date, event_id, est_demand_multiplier FROM local_events) e
      USING (metro_area, forecast_date)""", ("forecast_date",))(
    lambda t: t.weather_conditions.join(t.local_events.withColumnRenamed("event_date", "forecast_date"),
                                        ["metro_area", "forecast_date"], "left").select(
        "metro_area", "forecast_date", "event_id",
        F.round(wx.combine(F.col("demand_multiplier"), F.col("est_demand_multiplier")), 4).alias("multiplier")))
query("event_id", "SELECT report_id, event_id FROM event_report")(
    lambda t: payload_feeds.event_rows(t.happening_feed).select("report_id", "event_id"))
query("event_id_per_metro", f"""SELECT report_id, {EVENT_ID} FROM happening_feed""")(
    lambda t: payload_feeds.event_rows(t.happening_feed, per_metro_holidays=True).select("report_id", "event_id"))
query("merge_event_sources", "SELECT * FROM local_events", ("event_date",))(lambda t: t.local_events)
LOOKUP = """(SELECT coalesce(w.metro_area,e.metro_area) metro_area, coalesce(w.forecast_date,e.event_date) forecast_date,
      w.* EXCLUDE (metro_area, forecast_date), event_category, est_attendance, est_demand_multiplier event_demand_multiplier
      FROM weather_conditions w FULL JOIN (SELECT metro_area, event_date, event_category, est_attendance, est_demand_multiplier
      FROM local_events QUALIFY row_number() OVER (PARTITION BY metro_area, event_date ORDER BY event_id DESC)=1) e
      ON e.metro_area=w.metro_area AND e.event_date=w.forecast_date)"""
query("refresh_weather_events", RISK.replace("local_events", "refreshed_events"), ("forecast_date",))(lambda t: refreshed_outlook(t))


def refreshed_outlook(t):
    """Payloads in two runs, history up to today first, then all of them; the outlook from the stored tables."""
    today = t.spark.range(1).select(t.today.alias("d")).first().d
    job = refresh.Refresh(t.spark, sinks.fresh(t.spark, "refresh"), t.unit)
    feeds = {"forecasts": payload_feeds.forecasts(t), "alerts": payload_feeds.alerts(t), "holidays": payload_feeds.holidays(t),
             "tickets": payload_feeds.tickets(t), "seats": payload_feeds.seats(t)}
    early = feeds | {"forecasts": feeds["forecasts"].filter(F.xxhash64("payload") % 2 == 0), "tickets": feeds["tickets"].limit(0)}
    job.run(early, today)
    job.run(feeds, today)
    return job.outlook(today)


query("weather_event_lookup", f"SELECT * FROM {LOOKUP}", ("forecast_date",))(lambda t: lookup(t))


def lookup(t):
    return enrich.weather_event_lookup(t.weather_conditions, t.local_events)


# ---- derivations
query("make_id", f"SELECT guest_order_id, {mid(chr(39) + 'o' + chr(39), 'unit_id', 'guest_order_id')} id FROM guest_order")(
    lambda t: t.guest_order.select("guest_order_id", make_id("o", F.col("unit_id"), F.col("guest_order_id")).alias("id")))


def _calendar(d):
    m, dd, w = f"month({d})", f"day({d})", f"isodow({d})"
    rules = [(f"{m}=2 AND {w}=7 AND {dd} BETWEEN 8 AND 14", True, "super_bowl", 3.2)]
    rules += [(f"{m}={a} AND {dd}={b}", True, n, x) for a, b, n, x in derive.FIXED_DAYS]
    rules += [(f"{m}=11 AND {w}=5 AND {dd} BETWEEN 23 AND 29", True, "black_friday", 1.6),
              (f"{w}=7 AND (({m}=9 AND {dd}>=7) OR {m} IN (10,11,12) OR ({m}=1 AND {dd}<=15))", True, "nfl_sunday", 2.0),
              (f"{m}=6 AND {w}=5", False, "summer_friday", 1.4), (f"{m}=1", False, None, 0.85)]
    text = lambda v: "NULL" if v is None else f"'{v}'"
    pick = lambda i, fmt, default: "CASE " + " ".join(f"WHEN {r[0]} THEN {fmt(r[i])}" for r in rules) + f" ELSE {default} END"
    return (pick(1, str, "false"), pick(2, text, "NULL"), f"({pick(3, str, '1.0')})::DOUBLE")


HOLIDAY, HOLIDAY_NAME, EVENT_X = _calendar("date")
query("calendar_events", f"""SELECT date, {HOLIDAY} is_holiday, {HOLIDAY_NAME} holiday_name, {EVENT_X} event_multiplier
      FROM (SELECT DISTINCT CAST(placed_at AS DATE) date FROM guest_order)""", ("date",))(
    lambda t: derive.calendar_events(t.guest_order.select(F.to_date("placed_at").alias("date")).distinct()))
_H, _N, _X = _calendar("forecast_date")
GRID = """(SELECT unit_id, date_trunc('hour',placed_at) hour_start, CAST(placed_at AS DATE) forecast_date, count(*) orders
      FROM guest_order GROUP BY 1,2,3)"""
DEMAND = f"""(SELECT unit_id, hour_start, orders, CAST(hour(hour_start) AS INTEGER) hour_of_day, {_H} is_holiday,
      {_N} holiday_name, greatest({_X},coalesce(event_demand_multiplier,{_X})) event_multiplier, unit_volume_bias b,
      (CAST({list(derive.HOURLY)} AS DOUBLE[]))[hour(hour_start)+1] h, (CAST({list(derive.WEEKDAY)} AS DOUBLE[]))[isodow(forecast_date)] d,
      coalesce(demand_multiplier,1.0::DOUBLE) w, channel_shift_delivery FROM {GRID} g JOIN unit USING (unit_id)
      LEFT JOIN {LOOKUP} l USING (metro_area, forecast_date))"""
query("expected_demand", f"""SELECT unit_id, hour_start, orders, hour_of_day, is_holiday, holiday_name, event_multiplier,
      18.0::DOUBLE*h*d*event_multiplier*b*w expected_orders,
      0.08::DOUBLE+greatest(0.0::DOUBLE,(event_multiplier-1.5::DOUBLE)*0.05::DOUBLE) sos_breach_probability,
      channel_shift_delivery FROM {DEMAND}""", ("hour_start",))(lambda t: demand(t))
query("sos_expectation", f"""SELECT date, 0.08::DOUBLE+greatest(0.0::DOUBLE,({EVENT_X}-1.5::DOUBLE)*0.05::DOUBLE) sos_breach_probability
      FROM (SELECT DISTINCT CAST(placed_at AS DATE) date FROM guest_order)""", ("date",))(
    lambda t: derive.calendar_events(t.guest_order.select(F.to_date("placed_at").alias("date")).distinct()).select(
        "date", derive.sos_expectation(F.col("event_multiplier")).alias("sos_breach_probability")))
LATE_NIGHT = "CASE WHEN hour_of_day>=22 OR hour_of_day<=1 THEN 0.15 ELSE 0.0 END::DOUBLE"
WET = "greatest(0.0::DOUBLE,coalesce(channel_shift_delivery,0.0::DOUBLE))"
query("channel_mix", f"""SELECT unit_id, hour_start, least(1.0::DOUBLE,least(1.0::DOUBLE,0.4::DOUBLE+{LATE_NIGHT})+{WET}) third_party,
      0.16::DOUBLE own_delivery, greatest(0.0::DOUBLE,greatest(0.0::DOUBLE,0.4::DOUBLE-{LATE_NIGHT})-{WET}) carryout,
      0.04::DOUBLE catering FROM {DEMAND}""".replace("END::DOUBLE", "END"), ("hour_start",))(lambda t: mix(t))
query("daypart_items", f"""SELECT category, count(*) FILTER (WHERE daypart='all_day' OR hour(placed_at) BETWEEN 10 AND 14) lines_in_daypart,
      count(*) AS lines FROM order_item JOIN menu_item USING (menu_item_id) GROUP BY 1""")(lambda t: daypart(t))
PRICED = f"""SELECT order_item_id, guest_order_id, menu_item_id, quantity, c/100.0::DOUBLE unit_price,
      c*quantity/100.0::DOUBLE line_gross_amount FROM (SELECT i.*, {HU(f"{fx('base_price', 100)}*{fx('coalesce(price_multiplier,1.0)')}*{fx('market_price_index')}", '100000000')}
      + CASE WHEN channel='3pd_delivery' THEN 125 ELSE 0 END c FROM order_item i JOIN guest_order g USING (guest_order_id)
      JOIN menu_item m USING (menu_item_id) JOIN unit u ON u.unit_id=g.unit_id LEFT JOIN item_price p
      ON p.menu_item_id=m.menu_item_id AND p.financial_period_id=g.financial_period_id)"""
query("price_line", PRICED)(
    lambda t: derive.price_line(t.order_item, t.guest_order, t.menu_item, t.item_price, t.unit))
DISCOUNTED = f"""(SELECT order_item_id, guest_order_id, gross, {HU('gross*least(asked,total)', 'total')} d FROM (SELECT i.order_item_id,
      guest_order_id, {fx('line_gross_amount', 100)} gross, {fx('g.discount_amount', 100)} asked,
      CAST(sum({fx('line_gross_amount', 100)}) OVER (PARTITION BY guest_order_id) AS BIGINT) total
      FROM order_item i JOIN guest_order g USING (guest_order_id)))"""
query("allocate_discount", f"""SELECT order_item_id, guest_order_id, gross/100.0::DOUBLE line_gross_amount,
      d/100.0::DOUBLE line_discount_amount, (gross-d)/100.0::DOUBLE line_net_amount FROM {DISCOUNTED}""")(
    lambda t: derive.allocate_discount(t.order_item, t.guest_order))
query("order_totals", f"""SELECT guest_order_id, order_status, s/100.0::DOUBLE subtotal, {HU('s*85', '1000')}/100.0::DOUBLE tax_amount,
      CASE WHEN order_status='cancelled' THEN 0 ELSE s+{HU('s*85', '1000')} END/100.0::DOUBLE total_amount FROM (SELECT guest_order_id,
      {I('gross-d')} s FROM {DISCOUNTED} GROUP BY 1) JOIN guest_order USING (guest_order_id)""")(
    lambda t: derive.order_totals(derive.allocate_discount(t.order_item, t.guest_order), t.guest_order))
query("fiscal_period", """SELECT d.date, coalesce(p.financial_period_id,(SELECT max(financial_period_id) FROM financial_period))
      financial_period_id FROM (SELECT DISTINCT CAST(placed_at AS DATE)+20 date FROM guest_order) d LEFT JOIN financial_period p
      ON d.date BETWEEN CAST(start_date AS DATE) AND CAST(end_date AS DATE)""", ("date",))(
    lambda t: derive.fiscal_period(t.guest_order.select(F.date_add(F.to_date("placed_at"), 20).alias("date")), t.financial_period))
query("financial_periods", "SELECT * FROM financial_period")(lambda t: t.financial_period)
BOM = f"""(SELECT unit_id, date_trunc('hour',placed_at) tick, stock_sku, CAST(sum({fx('r.quantity')}*o.quantity) AS BIGINT)/10000 quantity_used
      FROM order_item o JOIN recipe_ingredient r USING (menu_item_id) GROUP BY 1,2,3)"""
query("bom_depletion", f"SELECT * FROM {BOM}", ("tick",))(lambda t: derive.bom_depletion(t.order_item, t.recipe_ingredient))
query("replenishment", f"""SELECT *, round(20.0::DOUBLE-quantity_on_hand,3) order_quantity FROM (SELECT *,
      round(greatest(0.0::DOUBLE,20.0::DOUBLE-quantity_used),3) quantity_on_hand FROM {BOM}) WHERE quantity_on_hand<5""", ("tick",))(
    lambda t: derive.replenishment(derive.bom_depletion(t.order_item, t.recipe_ingredient)))
query("waste_cost", f"SELECT waste_log_id, {HU(fx('waste_quantity') + '*25', '1000')}/100.0::DOUBLE cost FROM waste_log")(
    lambda t: t.waste_log.select("waste_log_id", derive.waste_cost(F.col("waste_quantity")).alias("cost")))
query("tier_for_spend", """SELECT member_id, max(tier) tier FROM member_order GROUP BY 1""")(
    lambda t: t._member_orders.groupBy("member_id").agg(F.max("tier").alias("tier")))
query("points_accrual", "SELECT guest_order_id, tier, points_delta FROM loyalty_transaction WHERE transaction_type='earn'")(
    lambda t: t.loyalty_transaction.filter(F.col("transaction_type") == "earn").select("guest_order_id", "tier", "points_delta"))
query("reward_value", """SELECT member_id, guest_order_id, 'reward' entry, CAST(0 AS BIGINT) points_delta, points_redeemed/100.0::DOUBLE
      reward_value FROM reward_redemption UNION ALL SELECT member_id, guest_order_id, 'redeem', CAST(-points_redeemed AS BIGINT), 0.0::DOUBLE
      FROM reward_redemption""")(lambda t: derive.redemption_ledger(t.reward_redemption))
SECS = "CAST(epoch(date_trunc('second',punch_out))-epoch(date_trunc('second',punch_in)) AS BIGINT)"
query("hours_worked", f"""SELECT time_punch_id, {HU(SECS, '36')}/100.0::DOUBLE hours, {HU(f'({SECS})%86400', '36')}/100.0::DOUBLE wrapped
      FROM time_punch""".replace(" hours,", " AS hours,"))(lambda t: t.time_punch.select(
          "time_punch_id", derive.hours_worked(F.col("punch_in"), F.col("punch_out")).alias("hours"),
          derive.hours_worked(F.col("punch_in"), F.col("punch_out"), wrap_days=True).alias("wrapped")))
query("staff_plan", """SELECT unit_id, date, CAST(i AS INTEGER) slot, ['open','mid','close','overlap'][i%4+1] shift_label,
      ['10:00','14:00','17:00','12:00'][i%4+1] shift_start, ['16:00','21:00','23:00','20:00'][i%4+1] shift_end FROM
      (SELECT unit_id, CAST(placed_at AS DATE) date, CAST(sum(quantity) AS BIGINT) n FROM order_item GROUP BY 1,2), range(15) r(i)
      WHERE i<least(15,greatest(3,n//25))""", ("date",))(lambda t: derive.staff_plan(t.order_item.groupBy(
          "unit_id", F.to_date("placed_at").alias("date")).agg(F.sum("quantity").alias("order_count"))))
query("region_assignment", """SELECT unit_id, metro_area, dense_rank() OVER (ORDER BY metro_area) district_id,
      (dense_rank() OVER (ORDER BY metro_area)-1)//4+1 region_id FROM unit""")(lambda t: derive.region_assignment(t.unit))
query("price_drift", f"""SELECT menu_item_id, financial_period_id, m/10000.0::DOUBLE price_multiplier FROM (WITH RECURSIVE
      step(menu_item_id, financial_period_id, m) AS (SELECT p_partkey, CAST(0 AS BIGINT), CAST(10000 AS BIGINT) FROM part UNION ALL
      SELECT s.menu_item_id, s.financial_period_id+1, least(14000,greatest(7000,
      {HU('m*(100+(s.menu_item_id+(s.financial_period_id+1)*7)%10-3)', '100')})) FROM step s
      WHERE s.financial_period_id<(SELECT count(*) FROM financial_period)) SELECT * FROM step) WHERE financial_period_id>0""")(
    lambda t: derive.price_drift(t.item_price.select("menu_item_id", "financial_period_id", (
        ((F.col("menu_item_id") + F.col("financial_period_id") * 7) % 10 - 3) / F.lit(100.0)).alias("drift"))))
query("sku_universe", "SELECT DISTINCT stock_sku FROM recipe_ingredient")(
    lambda t: t.recipe_ingredient.select("stock_sku").distinct())


def demand(t):
    grid = t.guest_order.groupBy("unit_id", F.date_trunc("hour", "placed_at").alias("hour_start")).agg(
        F.count(F.lit(1)).alias("orders"))
    return derive.expected_demand(grid, t.unit, lookup(t))


def mix(t):
    shares = derive.channel_mix(F.col("hour_of_day"), F.col("channel_shift_delivery"))
    names = {"3pd_delivery": "third_party"}
    return demand(t).select("unit_id", "hour_start", *[c.alias(names.get(n, n)) for n, c in shares.items()])


def daypart(t):
    per = t.order_item.groupBy("menu_item_id", F.hour("placed_at").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    inside = derive.sold_in_daypart(F.col("daypart"), F.col("h"))
    return per.join(t.menu_item.select("menu_item_id", "category", "daypart"), "menu_item_id").groupBy("category").agg(
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("lines_in_daypart"), F.sum("n").alias("lines"))
