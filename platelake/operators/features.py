"""Customer and store features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.functions.numeric import fixed
from platelake.operators.joins import left_join

CATEGORIES = ("pizza", "wings", "sides", "salads", "drinks", "desserts")


def latest_tier(loyalty_transaction: DataFrame) -> DataFrame:
    """Tier of each member's newest transaction; the higher id breaks ties."""
    return (
        loyalty_transaction.filter(F.col("member_id").isNotNull()).groupBy("member_id")
        .agg(F.max_by("tier", F.struct("transaction_at", "loyalty_transaction_id")).alias("tier")))


def customer_features(guest_order: DataFrame, order_item: DataFrame, tiers: DataFrame,
                      menu_item: DataFrame, as_of: Column) -> DataFrame:
    """Recency, frequency, value, tier and category affinity per known profile.

    Anonymous orders are dropped first.  Spend is added up per profile and
    category with partial aggregation, so no customer is ever gathered whole.
    """
    known = guest_order.filter(F.col("profile_id").isNotNull())
    value = F.coalesce(F.sum(fixed("total_amount")), F.lit(0))
    orders = known.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("total_orders"), value.alias("value"), F.max("placed_at").alias("last_at"))
    spend = (
        order_item.select("guest_order_id", "menu_item_id", "line_net_amount")
        .join(known.select("guest_order_id", "profile_id"), "guest_order_id")
        .join(menu_item.select("menu_item_id", "category"), "menu_item_id")
        .groupBy("profile_id")
        .agg(*[F.sum(F.when(F.col("category") == c, fixed("line_net_amount"))).alias(f"spend_{c}") for c in CATEGORIES]))
    total = sum((F.coalesce(f"spend_{c}", F.lit(0)) for c in CATEGORIES), F.lit(0))
    money = F.col("value") / F.lit(10_000)
    tier = tiers.select(F.col("member_id").alias("profile_id"), "tier")
    affinity = [F.when(total > 0, F.round(F.coalesce(f"spend_{c}", F.lit(0)) / total, 6)).otherwise(F.lit(0.0))
                .alias(f"affinity_{c}") for c in CATEGORIES]
    return orders.join(spend, "profile_id", "left").join(tier, "profile_id", "left").select(
        "profile_id", "total_orders", F.round(money, 4).alias("monetary_total"),
        F.round(money / F.col("total_orders"), 4).alias("aov"),
        F.coalesce(F.date_diff(F.to_date(as_of), F.to_date("last_at")), F.lit(-1)).alias("recency_days"),
        F.coalesce("tier", F.lit("none")).alias("tier"), *affinity)


def item_quantities(order_item: DataFrame) -> DataFrame:
    return order_item.groupBy("unit_id", "menu_item_id").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"))


def item_popularity(order_item: DataFrame) -> DataFrame:
    """Quantity sold relative to the unit's best seller, one row per unit and item."""
    sold = item_quantities(order_item)
    best = sold.groupBy("unit_id").agg(F.max("quantity").alias("best"))
    share = F.round(F.col("quantity") / F.when(F.col("best") > 0, F.col("best")).otherwise(1), 6)
    return sold.join(best, "unit_id").select("unit_id", "menu_item_id", "quantity", share.alias("popularity"))


def top_items(order_item: DataFrame, menu_item: DataFrame) -> DataFrame:
    """Best-selling item per unit and category; the lowest id wins a tie."""
    sold = item_quantities(order_item).join(menu_item.select("menu_item_id", "category"), "menu_item_id")
    return sold.filter(F.col("category").isin(*CATEGORIES)).groupBy("unit_id", "category").agg(
        F.max_by("menu_item_id", F.struct("quantity", -F.col("menu_item_id"))).alias("menu_item_id"))


def store_features(guest_order: DataFrame, order_item: DataFrame, unit: DataFrame,
                   menu_item: DataFrame) -> DataFrame:
    """Order volume, value and best sellers per unit that has orders.

    Per-item popularity stays a table of its own (:func:`item_popularity`);
    :func:`with_popularity` folds it into a map where a catalogue is small.
    """
    orders = guest_order.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("store_orders"), F.coalesce(F.sum(fixed("total_amount")), F.lit(0)).alias("value"))
    best = top_items(order_item, menu_item).groupBy("unit_id").pivot("category", list(CATEGORIES)).agg(
        F.first("menu_item_id"))
    best = best.select("unit_id", *[F.col(c).alias(f"top_{c}") for c in CATEGORIES])
    owner = unit.select("unit_id", "metro_area", "region_id", "franchisee_id", F.lit(True).alias("listed"))
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"top_{c}").alias("value")) for c in CATEGORIES]),
                       lambda e: e["value"].isNotNull())
    return orders.join(best, "unit_id", "left").join(owner, "unit_id", "left").select(
        "unit_id", F.coalesce("metro_area", F.when(F.col("listed").isNull(), F.lit("unknown"))).alias("metro_area"),
        F.coalesce("region_id", F.when(F.col("listed").isNull(), F.lit(-1))).cast("bigint").alias("region_id"),
        F.coalesce("franchisee_id", F.when(F.col("listed").isNull(), F.lit(-1))).cast("bigint").alias("franchisee_id"),
        "store_orders", F.round(F.col("value") / F.lit(10_000) / F.col("store_orders"), 4).alias("store_aov"),
        F.map_from_entries(entries).alias("top_item_per_category"))


def store_values(guest_order: DataFrame, unit: DataFrame) -> DataFrame:
    """``unit_id`` and ``store_aov`` of :func:`store_features`, without a look at the items."""
    orders = guest_order.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("store_orders"), F.coalesce(F.sum(fixed("total_amount")), F.lit(0)).alias("value"))
    return orders.join(unit.select("unit_id"), "unit_id", "left").select(
        "unit_id", F.round(F.col("value") / F.lit(10_000) / F.col("store_orders"), 4).alias("store_aov"))


def with_popularity(store: DataFrame, popularity: DataFrame) -> DataFrame:
    """Add the item -> share map; its size per unit is the size of the catalogue."""
    maps = popularity.groupBy("unit_id").agg(F.map_from_entries(
        F.collect_list(F.struct("menu_item_id", "popularity"))).alias("popularity"))
    empty = F.create_map().cast("map<bigint,double>")
    return store.join(maps, "unit_id", "left").withColumn("popularity", F.coalesce("popularity", empty))


def serialised(store: DataFrame) -> DataFrame:
    """Storage form: maps as JSON text."""
    maps = [c for c, t in store.dtypes if t.startswith("map<")]
    return store.withColumns({c: F.to_json(c) for c in maps})


def feature_lookup(requests: DataFrame, customers: DataFrame, stores: DataFrame, heavy_stores: tuple = ()) -> DataFrame:
    """Requests (profile_id, store_id) enriched with both feature tables; misses stay NULL.

    Anonymous requests are dealt out instead of meeting in one task, and so are those of ``heavy_stores``.
    """
    stores = stores.withColumnRenamed("unit_id", "store_id")
    return left_join(left_join(requests, customers, "profile_id"), stores, "store_id", heavy_stores)
