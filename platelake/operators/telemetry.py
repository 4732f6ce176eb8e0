"""Live telemetry -> order envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake import schemas
from platelake.functions.ids import make_id
from platelake.functions.numeric import half_up

ORDER_SPAN = "order-tracker received order"

# Tax rate in per mille, noise prefixes, channel and stage vocabulary.
TAX_PER_MILLE = 85
NOISE_PREFIXES = ("fee-test", "c2-verify")
STAGE_STATES = {
    "prep": "preparing", "bake": "preparing", "qualitycheck": "preparing",
    "readyforpickup": "ready", "outfordelivery": "ready", "delivered": "fulfilled",
}


def from_nanos(nanos: Column) -> Column:
    """Exact timestamp of epoch nanoseconds, cut to microseconds."""
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / F.lit(1000)).cast("bigint"))


def newer_than(nanos: Column, since: Column) -> Column:
    """Strictly newer, compared on the stored column so the scan can use it."""
    return nanos > F.unix_micros(since) * 1000 + F.lit(999)


def event_time(event_ts: Column, nanos: Column) -> Column:
    """The record's own timestamp text when it parses, else its nanoseconds."""
    return F.coalesce(F.try_to_timestamp(event_ts), from_nanos(nanos))


def parse_skus(raw: Column) -> Column:
    """Array of (menu_item_id, quantity) found as '<id> x<qty>' anywhere in the text."""
    found = F.transform(
        F.arrays_zip(F.regexp_extract_all(raw, F.lit(r"(\d+)\s*[xX]\s*(\d+)"), F.lit(1)).alias("i"),
                     F.regexp_extract_all(raw, F.lit(r"(\d+)\s*[xX]\s*(\d+)"), F.lit(2)).alias("q")),
        lambda p: F.struct(p["i"].try_cast("bigint").alias("menu_item_id"),
                           p["q"].try_cast("bigint").alias("quantity")))
    kept = F.filter(found, lambda p: (p["quantity"] > 0) & (p["menu_item_id"] > 0))
    return F.coalesce(kept, F.array().cast("array<struct<menu_item_id:bigint,quantity:bigint>>"))


def parse_member_id(raw: Column) -> Column:
    """Positive member number, or NULL; whether the member exists is a join's matter."""
    member = F.trim(raw).try_cast("bigint")
    return F.when(member > 0, member)


def is_noise(user_id: Column) -> Column:
    out = F.lit(False)
    for prefix in NOISE_PREFIXES:
        out = out | F.coalesce(user_id.startswith(prefix), F.lit(False))
    return out


def logs_scan(logs: DataFrame, since: Column | None = None) -> DataFrame:
    """Order records with a positive amount and a time, newer than ``since``.

    The time is the record's own text (``event_ts``, where the table has it and it parses), else its nanoseconds.
    """
    a, nanos = F.col("attributes"), F.col("time_unix_nano")
    told = F.col("event_ts").cast("string") if "event_ts" in logs.columns else None
    at = from_nanos(nanos) if told is None else event_time(told, nanos)
    if since is not None:
        newer = newer_than(nanos, since) if told is None else at > since
        logs = logs.filter(since.isNull() | newer)
    return logs.select(
        "trace_id", "time_unix_nano", at.alias("event_ts"),
        a["app.order.id"].alias("order_id"), a["app.order.member_id"].alias("member_id"),
        a["app.order.amount"].try_cast("double").alias("amount"),
        a["app.order.items.count"].try_cast("int").alias("items_count"),
        a["app.shipping.amount"].try_cast("double").alias("shipping_amount"),
        a["app.shipping.tracking.id"].alias("tracking_id"), a["user.id"].alias("user_id"),
    ).filter((F.col("amount") > 0) & F.col("event_ts").isNotNull())


def order_spans(spans: DataFrame) -> DataFrame:
    """Order and stage spans with their attributes as columns."""
    a = F.col("attributes")
    return spans.filter((F.col("name") == ORDER_SPAN) | F.col("name").like("stage:%")).select(
        "trace_id", "name", "start_time_unix_nano", a["order.store_id"].alias("store_id"),
        a["order.channel"].alias("channel"), a["order.skus"].alias("skus"),
        a["order.item_count"].try_cast("int").alias("item_count"),
        a["order.prep_seconds"].try_cast("int").alias("prep_seconds"),
        a["order.location.state"].alias("state"), a["order.location.city"].alias("city"),
        a["order.location.zip"].alias("zip"), a["sos.target_seconds"].try_cast("int").alias("sos_target"))


def spans_scan(spans: DataFrame, log_rows: DataFrame) -> DataFrame:
    """Order and stage spans of the traces in ``log_rows``."""
    return order_spans(spans).join(log_rows.select("trace_id").distinct(), "trace_id", "left_semi")


def stage_of(name: Column) -> Column:
    """Stage of a stage span's name, lower-cased and stripped of spaces; NULL for other spans."""
    stage = F.replace(F.lower(F.trim(F.substring_index(name, ":", -1))), F.lit(" "), F.lit(""))
    return F.when(name.like("stage:%"), stage)


def span_index() -> list[Column]:
    """Aggregates over the spans of a trace: facts of the newest order span, and its stages, each once."""
    is_order = F.col("name") == ORDER_SPAN
    facts = F.struct("store_id", "channel", "skus", "prep_seconds", "state", "sos_target")
    return [F.max_by(facts, F.when(is_order, F.col("start_time_unix_nano"))).alias("span"),
            F.array_sort(F.collect_set(stage_of(F.col("name")))).alias("stages")]


def index_spans(span_rows: DataFrame) -> DataFrame:
    """Per trace the newest order span, the stages and their number, in one pass; a stage sent twice is one."""
    return span_rows.groupBy("trace_id").agg(*span_index()).withColumn("stage_count", F.size("stages"))


def unit_pools(unit: DataFrame) -> DataFrame:
    """Numbered units of every state (``everyone`` false) and of the whole chain (true).

    The unit dimension is a few rows per store, so numbering it is cheap.  Units without a state are in the pool of the
    chain only.
    """
    rows = unit.select(F.col("state").alias("pool"), "unit_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("everyone"))
    rows = rows.filter(F.col("everyone") | F.col("pool").isNotNull())
    rows = rows.withColumn("pool", F.when(F.col("everyone"), F.lit("")).otherwise(F.col("pool")))
    from pyspark.sql import Window

    own = Window.partitionBy("everyone", "pool")
    return rows.select("everyone", "pool", "unit_id", (F.row_number().over(own.orderBy("unit_id")) - 1).alias("slot"),
                       F.count(F.lit(1)).over(own).alias("pool_size"))


def map_store_to_unit(rows: DataFrame, unit: DataFrame, store: str = "store_key",
                      state: str = "state") -> DataFrame:
    """Add ``unit_id``: a hash slot in the state's pool, or in all units if it has none."""
    pools = unit_pools(unit)
    sizes = pools.filter(F.col("slot") == 0)
    chain = sizes.filter("everyone").select("pool_size").scalar()
    by_state = sizes.filter("NOT everyone").select("pool", "pool_size")
    sized = rows.join(by_state, F.col(state) == F.col("pool"), "left")
    slotted = sized.withColumns({
        "slot": F.pmod(make_id("otel-store", F.col(store)), F.coalesce("pool_size", chain)).cast("int"),
        "everyone": F.col("pool").isNull(), "pool": F.coalesce("pool", F.lit(""))}).drop("pool_size")
    return slotted.join(pools.drop("pool_size"), ["everyone", "pool", "slot"]).drop("everyone", "pool", "slot")


def order_base(logs: DataFrame, spans: DataFrame, unit: DataFrame, since: Column | None = None) -> DataFrame:
    """One row per accepted log record with everything the five projections need."""
    log_rows = logs_scan(logs, since).filter(~is_noise(F.col("user_id")))
    indexed = index_spans(spans_scan(spans, log_rows))
    return order_rows(log_rows.join(indexed, "trace_id", "left"), unit)


def order_rows(traced: DataFrame, unit: DataFrame) -> DataFrame:
    """Order rows of log records with their ``span`` and ``stages`` (NULL where a trace has no spans)."""
    total = F.floor(F.col("amount") * 100 + F.lit(0.5))
    sub = half_up(total * 1000, F.lit(1000 + TAX_PER_MILLE))
    prep = F.coalesce("span.prep_seconds", F.lit(0))
    target = F.coalesce(F.nullif(F.col("span.sos_target"), F.lit(0)), F.lit(1800))
    channel = F.when(F.col("span.channel") == "delivery", "own_delivery").otherwise("carryout")
    rows = traced.select(
        "trace_id", "event_ts", "tracking_id", parse_member_id(F.col("member_id")).alias("member_id"),
        F.col("span.state").alias("state"), F.coalesce("span.store_id", "trace_id").alias("store_key"),
        channel.alias("channel"),
        F.when(channel == "own_delivery", "delivery").otherwise(channel).alias("order_type"),
        total.alias("total_cents"), sub.alias("subtotal_cents"), prep.alias("prep_seconds"),
        target.alias("sos_target"), (prep > target).alias("sos_breach"),
        parse_skus(F.col("span.skus")).alias("skus"), "stages",
        make_id("otel", F.col("trace_id")).alias("guest_order_id"))
    all_units = F.aggregate("skus", F.lit(0).cast("bigint"), lambda acc, s: acc + s["quantity"])
    return map_store_to_unit(rows.withColumn("all_units", all_units), unit)


def trace_stream(logs: DataFrame, spans: DataFrame, delay: str, reach: str) -> DataFrame:
    """Log records and spans, both as streams, joined to one row a trace as ``order_rows`` reads it.

    A record delivered again is dropped while its first delivery is remembered, later by the watermark.  A span belongs to a
    record of its trace if it starts within ``reach`` of it, before or after.  A trace's row comes out once the watermark
    (newest time of the slower stream, less ``delay``) has passed its record by ``reach``, so spans later than their log
    still count.  State is bounded: records and spans of the last ``delay`` plus twice ``reach``.  Records that are older than
    the watermark on arrival are dropped, hence ``delay`` must cover the feed's lateness.
    """
    records = (logs_scan(logs).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["trace_id"])
               .filter(~is_noise(F.col("user_id"))))
    parts = order_spans(spans).withColumn("span_at", from_nanos(F.col("start_time_unix_nano"))).withWatermark(
        "span_at", delay).withColumnRenamed("trace_id", "span_trace")
    near = F.expr(f"trace_id = span_trace AND span_at BETWEEN event_ts - INTERVAL {reach} AND event_ts + INTERVAL {reach}")
    found = records.join(parts, near, "leftOuter").drop("span_at", "span_trace")
    key = ["trace_id", "event_ts", "amount", "member_id", "tracking_id"]
    return found.groupBy(*key).agg(*span_index())


def _dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def _event(kind: str, key: Column, **columns: Column) -> Column:
    """An event of an order in the envelope's declared columns; absent ones are NULL."""
    given = {"event_type": F.lit(kind), "event_id": key, f"{kind}_id": key, "source": F.lit("otel"),
             **{c: F.col(c) for c in ("event_ts", "guest_order_id", "unit_id")}, **columns}
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ORDER_EVENTS.fields])


def order_events() -> Column:
    """The order itself."""
    return F.array(_event(
        "guest_order", F.col("guest_order_id"), channel=F.col("channel"), order_type=F.col("order_type"),
        order_status=F.lit("fulfilled"), profile_id=F.col("member_id"), member_id=F.col("member_id"),
        subtotal=_dollars(F.col("subtotal_cents")), discount_amount=F.lit(0.0),
        tax_amount=_dollars(F.col("total_cents") - F.col("subtotal_cents")), total_amount=_dollars(F.col("total_cents")),
        placed_at=F.col("event_ts"), sos_breach=F.col("sos_breach")))


def item_events() -> Column:
    """Subtotal spread over the lines by quantity; no price below one cent."""
    cents = lambda c: _dollars(F.greatest(F.lit(1), c))
    unit_price = cents(half_up(F.col("subtotal_cents"), F.col("all_units")))

    def line(sku: Column, i: Column) -> Column:
        amount = cents(half_up(F.col("subtotal_cents") * sku["quantity"], F.col("all_units")))
        return _event(
            "order_item", make_id("otel-item", F.col("trace_id"), i), menu_item_id=sku["menu_item_id"],
            quantity=sku["quantity"], unit_price=unit_price, line_gross_amount=amount, line_net_amount=amount,
            line_discount_amount=F.lit(0.0), item_status=F.lit("fulfilled"), waste_flag=F.lit(False),
            placed_at=F.col("event_ts"))

    return F.transform("skus", line)


def payment_events() -> Column:
    return F.array(_event(
        "payment", make_id("otel-pay", F.col("trace_id")), tender_type=F.lit("card"), amount=_dollars(F.col("total_cents")),
        settlement_date=F.to_date("event_ts").cast("string"), paid_at=F.col("event_ts")))


def status_events() -> Column:
    """One transition per stage span, or the standard three when a trace has none."""
    def move(prior: Column, current: Column, part: Column) -> Column:
        return _event(
            "status_event", make_id("otel-status", F.col("trace_id"), part), prior_state=prior, current_state=current,
            event_timestamp=F.col("event_ts"), elapsed_seconds_in_prior_state=F.col("prep_seconds"),
            sos_target_seconds=F.col("sos_target"), is_sos_breach=F.col("sos_breach") & (current == "ready"))

    def reached(stage: Column) -> Column:
        state = F.lit("preparing")
        for name, value in STAGE_STATES.items():
            state = F.when(stage == name, F.lit(value)).otherwise(state)
        return move(F.lit("placed"), state, stage)

    standard = F.array(*[move(F.lit(a), F.lit(b), F.lit(a)) for a, b in
                         (("placed", "preparing"), ("preparing", "ready"), ("ready", "fulfilled"))])
    return F.when(F.size("stages") > 0, F.transform("stages", reached)).otherwise(standard)


def delivery_events() -> Column:
    """One delivery, for delivery orders only."""
    took = F.col("prep_seconds") + 900
    one = _event(
        "delivery_order", make_id("otel-deliv", F.col("trace_id")), platform_order_reference=F.col("tracking_id"),
        estimated_delivery_seconds=took, actual_delivery_seconds=took, delivery_status=F.lit("delivered"))
    return F.filter(F.array(one), lambda _: F.col("order_type") == "delivery")


def events_of(base: DataFrame, *kinds: Column) -> DataFrame:
    """Envelope rows of the given event arrays, by one explode of the order rows."""
    return base.select(F.explode(F.concat(*kinds)).alias("event")).select("event.*")


def all_events() -> list[Column]:
    """The arrays of all five event types."""
    return [order_events(), item_events(), payment_events(), status_events(), delivery_events()]


def as_envelope(rows: DataFrame) -> DataFrame:
    """Rows in the order envelope's declared columns; absent ones are NULL."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schemas.ORDER_EVENTS.fields])


def reshape_orders(logs: DataFrame, spans: DataFrame, unit: DataFrame, since: Column | None = None) -> DataFrame:
    """All five event types in the order envelope's declared columns; logs and spans are read once."""
    return events_of(order_base(logs, spans, unit, since), *all_events())
