"""Derived views: demand outlook and live web orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.functions import weather as wx
from platelake.functions.ids import make_id
from platelake.operators.joins import left_join
from platelake.operators.telemetry import ORDER_SPAN, from_nanos


def demand_risk_forecast(unit: DataFrame, weather: DataFrame, events: DataFrame, today: Column,
                         horizon: int = 14, one_row_per_day: bool = False) -> DataFrame:
    """Demand outlook per unit and day from ``today`` to ``today + horizon``.

    Two events on one metro-day give two rows; ``one_row_per_day`` keeps the
    strongest event instead.  The signal is built per metro and only then spread
    over the metro's units.
    """
    window = weather.filter(F.col("forecast_date").between(today, F.date_add(today, horizon)))
    local = events.select(
        "metro_area", F.col("event_date").alias("forecast_date"), "event_name", "event_category", "venue",
        "est_attendance", F.col("est_demand_multiplier").alias("event_demand_multiplier"),
        F.col("source").alias("event_source"))
    if one_row_per_day:
        rest = [c for c in local.columns if c not in ("metro_area", "forecast_date")]
        best = F.max_by(F.struct(*rest), F.struct("event_demand_multiplier", "event_name")).alias("e")
        local = local.groupBy("metro_area", "forecast_date").agg(best).select(
            "metro_area", "forecast_date", "e.*")
    combined = wx.combine(F.col("demand_multiplier"), F.col("event_demand_multiplier"))
    signal = window.join(local, ["metro_area", "forecast_date"], "left").select(
        "metro_area", "forecast_date", "observation_type", "weather_condition", "alert_level",
        "high_temp_f", "low_temp_f", "precipitation_inches",
        F.col("demand_multiplier").alias("weather_demand_multiplier"), "channel_shift_delivery",
        "event_name", "event_category", "venue", "est_attendance", "event_demand_multiplier", "event_source",
        F.round(combined, 4).alias("combined_demand_multiplier"), wx.risk_level(combined).alias("risk_level"))
    return unit.select("unit_id", "metro_area", "franchisee_id", "region_id").join(signal, "metro_area")


def web_orders(logs: DataFrame) -> DataFrame:
    """One row per storefront order: the largest value of each field over its records."""
    a = F.col("attributes")
    amount = a["app.order.amount"].try_cast("double")
    rows = logs.filter(a["app.order.id"].isNotNull() & (amount > 0)).select(
        a["app.order.id"].alias("web_order_id"), "trace_id",
        a["app.order.member_id"].try_cast("bigint").alias("member_id"), amount.alias("web_amount"),
        a["app.order.items.count"].try_cast("int").alias("web_item_count"),
        a["app.shipping.tracking.id"].alias("web_tracking_id"),
        from_nanos(F.col("time_unix_nano")).alias("web_order_ts"))
    return rows.groupBy("web_order_id").agg(*[F.max(c).alias(c) for c in rows.columns if c != "web_order_id"])


def storefronts(spans: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return spans.filter(F.col("name") == ORDER_SPAN).groupBy("trace_id").agg(
        F.max(a["order.store_id"]).alias("web_store_id"),
        F.max(a["order.location.city"]).alias("web_store_city"),
        F.max(a["order.location.state"]).alias("web_store_state"),
        F.max(a["order.location.zip"]).alias("web_store_zip"),
        F.max(a["order.channel"]).alias("raw_channel"),
        F.max(a["order.total_quantity"].try_cast("int")).alias("web_total_quantity"))


def _customer(customer_features: DataFrame) -> DataFrame:
    return customer_features.select(
        F.col("profile_id").alias("member_id"), F.lit(True).alias("customer_known"),
        F.col("tier").alias("customer_tier"), F.col("total_orders").alias("customer_total_orders"),
        F.col("monetary_total").alias("customer_lifetime_spend"))


def order_reconciliation(logs, spans, guest_order, customer_features) -> DataFrame:
    """Web orders beside the typed orders and customers they map to."""
    silver = guest_order.select(
        "guest_order_id", F.lit(True).alias("landed"), "unit_id", "channel", "order_status",
        F.col("total_amount").alias("silver_total_amount"), F.col("placed_at").alias("silver_placed_at"))
    web = web_orders(logs).withColumn("guest_order_id", make_id("otel", F.col("trace_id")))
    return (
        web.join(storefronts(spans).drop("raw_channel", "web_total_quantity"), "trace_id", "left")
        .join(silver, "guest_order_id", "left").transform(left_join, _customer(customer_features), "member_id")
        .select(
            "web_order_id", "trace_id", "guest_order_id", "member_id", "web_amount", "web_item_count",
            "web_tracking_id", "web_order_ts", "web_store_id", "web_store_city", "web_store_state",
            "web_store_zip", F.coalesce("landed", F.lit(False)).alias("reconciled"), "unit_id", "channel",
            "order_status", "silver_total_amount", "silver_placed_at",
            F.round(F.col("web_amount") - F.col("silver_total_amount"), 2).alias("amount_diff"),
            F.coalesce("customer_known", F.lit(False)).alias("customer_matched"), "customer_tier",
            "customer_total_orders", "customer_lifetime_spend"))


def web_order_live(logs, spans, customer_features) -> DataFrame:
    """Order header straight from telemetry, with the newest fulfilment stage."""
    stage = spans.filter(F.col("name").like("stage:%")).groupBy("trace_id").agg(
        F.max_by(F.regexp_replace("name", r"^stage:\s*", ""), F.struct("start_time_unix_nano", "name"))
        .alias("order_stage"))
    raw = F.col("raw_channel")
    channel = F.when(raw == "delivery", "own_delivery").otherwise(F.coalesce(raw, F.lit("carryout")))
    return (
        web_orders(logs).drop("web_tracking_id").join(storefronts(spans), "trace_id", "left")
        .join(stage, "trace_id", "left").transform(left_join, _customer(customer_features), "member_id")
        .select(
            "web_order_id", "trace_id", "web_store_id", "web_store_city", "web_store_state", "web_store_zip",
            channel.alias("channel"), "web_amount", "web_item_count", "web_total_quantity", "order_stage",
            "web_order_ts", "member_id", F.coalesce("customer_known", F.lit(False)).alias("customer_matched"),
            "customer_tier", "customer_total_orders", "customer_lifetime_spend"))


def web_order_item_live(logs, spans, menu_item) -> DataFrame:
    """Order lines straight from telemetry at catalogue price."""
    skus = F.from_json(F.max(F.col("attributes")["order.skus"]), "array<string>")
    lines = (
        spans.filter(F.col("name") == ORDER_SPAN).groupBy("trace_id").agg(skus.alias("skus"))
        .select("trace_id", F.explode("skus").alias("sku"))
        .select("trace_id", F.get(F.split("sku", " x"), F.lit(0)).try_cast("bigint").alias("menu_item_id"),
                F.get(F.split("sku", " x"), F.lit(1)).try_cast("int").alias("quantity")))
    orders = web_orders(logs).select("web_order_id", "trace_id")
    menu = menu_item.select("menu_item_id", "item_name", "category", F.col("base_price").alias("unit_price"))
    return orders.join(lines, "trace_id").join(menu, "menu_item_id", "left").select(
        "web_order_id", "trace_id", "menu_item_id", "item_name", "category", "quantity", "unit_price",
        F.round(F.col("unit_price") * F.col("quantity"), 2).alias("line_amount"))
