"""Menu search, cart pricing, order history and occasions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelake.functions.numeric import fixed, half_up

TAX_PERCENT = 9


def menu_search(menu_item: DataFrame, query: str | None = None, category: str | None = None) -> DataFrame:
    """Items whose name contains the text, in the category, by id."""
    rows = menu_item
    if category:
        rows = rows.filter(F.col("category") == category)
    if query:
        rows = rows.filter(F.lower("item_name").contains(query.lower()))
    return rows.select("menu_item_id", "item_name", "category", "subcategory",
                       F.round("base_price", 2).alias("price")).orderBy("menu_item_id")


def price_lines(lines: DataFrame, menu_item: DataFrame) -> DataFrame:
    """Catalogue name and price on (cart_id, menu_item_id, quantity) lines; unknown items cost 0."""
    menu = menu_item.select("menu_item_id", "item_name", F.round("base_price", 2).alias("unit_price"))
    return lines.join(menu, "menu_item_id", "left").select(
        "cart_id", "menu_item_id", F.coalesce("item_name", F.lit("")).alias("item_name"),
        F.coalesce("quantity", F.lit(1)).alias("quantity"), F.coalesce("unit_price", F.lit(0.0)).alias("unit_price"))


def price_carts(lines: DataFrame, menu_item: DataFrame) -> DataFrame:
    """Subtotal, estimated tax and total of every cart."""
    sub = price_lines(lines, menu_item).groupBy("cart_id").agg(
        F.sum(fixed("unit_price", 100) * F.col("quantity")).alias("sub"))
    tax = half_up(F.col("sub") * TAX_PERCENT, F.lit(100))
    dollars = lambda c: c / F.lit(100.0)
    return sub.select("cart_id", dollars(F.col("sub")).alias("subtotal"), dollars(tax).alias("tax_estimate"),
                      dollars(F.col("sub") + tax).alias("total"), F.lit("USD").alias("currency"))


def recent_orders(guest_order: DataFrame, limit: int = 5) -> DataFrame:
    """Newest orders per profile; the row limit is applied before and after the shuffle."""
    newest = Window.partitionBy("profile_id").orderBy(F.col("placed_at").desc(), F.col("guest_order_id").desc())
    return guest_order.filter(F.col("profile_id").isNotNull()).select(
        "profile_id", "guest_order_id", "placed_at", "total_amount", F.row_number().over(newest).alias("recency")
    ).filter(F.col("recency") <= limit)


def occasions(unit: DataFrame, events: DataFrame, month: str | None = None, limit: int = 5) -> DataFrame:
    """First events of each unit's metro: those of ``month`` (yyyy-MM) if it has any, else the earliest.

    Events of the month sort before the others, so one ranking that keeps ``limit`` rows finds both cases.
    """
    hit = F.lit(False) if month is None else F.coalesce(F.col("event_date").cast("string").startswith(month), F.lit(False))
    early = Window.partitionBy("metro_area").orderBy(F.col("hit").desc(), "event_date", "event_id")
    rows = events.withColumn("hit", hit).withColumn("occasion", F.row_number().over(early)).filter(F.col("occasion") <= limit)
    few = rows.withColumn("any_hit", F.max("hit").over(Window.partitionBy("metro_area"))).filter(F.col("hit") | ~F.col("any_hit"))
    return unit.select("unit_id", "metro_area").join(
        few.select("metro_area", "occasion", "event_date", "event_name", "event_category"), "metro_area")
