"""Parameterised table functions.

Facts are reduced on their own keys before they meet a dimension, so what
crosses a join is one row per store, item or (store, person), not per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelake.functions.clock import last_days
from platelake.functions.numeric import favg, fixed, fsum, rate, ratio
from platelake.operators.silver import latest

def rows() -> Column:
    return F.count(F.lit(1))


def is_late() -> Column:
    return F.col("actual_delivery_seconds") > F.col("estimated_delivery_seconds")


def gap() -> Column:
    return F.col("actual_delivery_seconds") - F.col("estimated_delivery_seconds")


def earned() -> Column:
    return F.sum(F.when(F.col("points_delta") > 0, F.col("points_delta")).otherwise(0))


def redeemed() -> Column:
    return F.sum(F.when(F.col("points_delta") < 0, -F.col("points_delta")).otherwise(0))


def segment() -> Column:
    return F.when(F.col("member_id").isNotNull(), "member").otherwise("non_member")


def is_status(value: str) -> Column:
    return F.col("account_status") == value


def sos_compliance(guest_order, days=7, as_of=None, by="unit_id"):
    return last_days(guest_order, "placed_at", days, as_of).groupBy(by).agg(
        rows().alias("total_orders"), F.count_if("sos_breach").alias("sos_breaches"),
        rate(F.col("sos_breach")).alias("sos_breach_rate"))


def revenue_by_channel(guest_order, days=30, as_of=None):
    return last_days(guest_order, "placed_at", days, as_of).groupBy("channel").agg(
        rows().alias("orders"), fsum("total_amount").alias("revenue"), favg("total_amount").alias("avg_order_value"))


def item_sales(order_item, *extra, days=30, as_of=None):
    """Units and net revenue per item (and ``extra`` keys), summed before any join."""
    return last_days(order_item, "placed_at", days, as_of).groupBy("menu_item_id", *extra).agg(
        F.sum("quantity").alias("units_sold"), F.sum(fixed("line_net_amount")).alias("net"))


def top_menu_items(order_item, menu_item, unit_id, days=30, as_of=None, top=25):
    sold = item_sales(order_item.filter(F.col("unit_id") == unit_id), days=days, as_of=as_of)
    return sold.join(menu_item.select("menu_item_id", "item_name"), "menu_item_id").select(
        "menu_item_id", "item_name", "units_sold", (F.col("net") / F.lit(10_000)).alias("net_revenue")
    ).orderBy(F.desc("net_revenue"), "menu_item_id").limit(top)


def late_delivery_rate(delivery_order, days=7, as_of=None, ts="created_at"):
    return last_days(delivery_order, ts, days, as_of).groupBy("unit_id").agg(
        rows().alias("deliveries"), F.count_if(is_late()).alias("late_deliveries"), rate(is_late()).alias("late_rate"))


def loyalty_summary(loyalty, days=30, as_of=None):
    return last_days(loyalty, "transaction_at", days, as_of).groupBy("unit_id").agg(
        F.count_distinct("member_id").alias("active_members"), earned().alias("points_earned"),
        redeemed().alias("points_redeemed"),
        F.coalesce(ratio(redeemed(), earned()), F.lit(0.0)).alias("redemption_rate"))


def member_vs_nonmember(guest_order, days=30, as_of=None):
    return last_days(guest_order, "placed_at", days, as_of).groupBy(segment().alias("segment")).agg(
        rows().alias("orders"), fsum("total_amount").alias("revenue"), favg("total_amount").alias("avg_order_value"))


def tier_breakdown(loyalty, days=30, as_of=None):
    return last_days(loyalty, "transaction_at", days, as_of).groupBy("tier").agg(
        F.count_distinct("member_id").alias("members"), rows().alias("transactions"),
        F.sum("points_delta").alias("net_points"))


def waste_by_category(waste, days=30, as_of=None):
    return last_days(waste, "logged_at", days, as_of).groupBy("waste_category").agg(
        rows().alias("events"), fsum("waste_quantity").alias("waste_qty"), fsum("waste_cost").alias("waste_cost")
    ).orderBy(F.desc("waste_cost"))


def top_waste_stores(waste, days=30, as_of=None, top=25):
    return last_days(waste, "logged_at", days, as_of).groupBy("unit_id").agg(
        rows().alias("events"), fsum("waste_cost").alias("waste_cost")
    ).orderBy(F.desc("waste_cost"), "unit_id").limit(top)


def below_par(on_hand):
    """Newest snapshot per store and SKU where stock is below par."""
    now = latest(on_hand.select("unit_id", "stock_sku", "on_hand_balance_id", "snapshot_at", "quantity_on_hand",
                                "par_level"), ["unit_id", "stock_sku"], "snapshot_at", "on_hand_balance_id")
    return now.filter(F.col("quantity_on_hand") < F.col("par_level")).select(
        "unit_id", "stock_sku", "quantity_on_hand", "par_level",
        (F.col("par_level") - F.col("quantity_on_hand")).alias("shortfall"))


def below_par_skus(on_hand, unit_id):
    return below_par(on_hand.filter(F.col("unit_id") == unit_id)).drop("unit_id").orderBy(F.desc("shortfall"), "stock_sku")


def labor_hours(punches, days=7, as_of=None):
    return last_days(punches, "punch_in", days, as_of).groupBy("unit_id").agg(
        fsum("hours_worked").alias("labor_hours"), F.count_distinct("employee_id").alias("employees"),
        rows().alias("punches"))


def sales_per_labor_hour(punches, daily, days=7, as_of=None, sales_as_of=None):
    hours = last_days(punches, "punch_in", days, as_of).groupBy("unit_id").agg(fsum("hours_worked").alias("labor_hours"))
    start = F.date_sub(F.to_date(sales_as_of), days)
    sales = daily.filter(F.col("date") >= start).groupBy("unit_id").agg(fsum("daily_revenue").alias("revenue"))
    return hours.join(sales, "unit_id").withColumn(
        "sales_per_labor_hour", ratio(F.col("revenue"), F.col("labor_hours")))


def overtime_employees(punches, days=7, as_of=None, limit_hours=40):
    return last_days(punches, "punch_in", days, as_of).groupBy("employee_id").agg(
        F.max("unit_id").alias("unit_id"), fsum("hours_worked").alias("hours")).filter(F.col("hours") > limit_hours)


def demand_risk(forecast, today, days=7):
    return forecast.filter(F.col("forecast_date").between(today, F.date_add(today, days))).groupBy("unit_id").agg(
        F.max("metro_area").alias("metro_area"), rows().alias("risk_days"),
        favg("combined_demand_multiplier").alias("avg_demand_multiplier"),
        F.count_if(F.col("risk_level") == "demand_risk").alias("demand_risk_days"),
        F.count_if(F.col("risk_level") == "capacity_risk").alias("capacity_risk_days"))


def per_franchisee(per_unit: DataFrame, unit: DataFrame, *aggs: Column) -> DataFrame:
    """Roll per-store rows up to the owner; company stores form the NULL group."""
    return per_unit.join(unit.select("unit_id", "franchisee_id"), "unit_id").groupBy("franchisee_id").agg(*aggs)


def franchisee_scorecard(guest_order, waste, punches, unit, days=30, as_of=None, waste_as_of=None, labor_as_of=None):
    """Orders, waste and labour per franchisee.

    Waste and labour attach by franchisee id, so the NULL group keeps them NULL.
    """
    per_unit = last_days(guest_order, "placed_at", days, as_of).groupBy("unit_id").agg(
        F.sum(fixed("total_amount")).alias("cents"), rows().alias("n"), F.count_if("sos_breach").alias("breached"))
    orders = per_franchisee(
        per_unit, unit, F.count_distinct("unit_id").alias("stores"),
        (F.sum("cents") / F.lit(10_000)).alias("revenue"), F.sum("n").alias("orders"),
        (F.sum("cents") / F.lit(10_000) / F.sum("n")).alias("avg_order_value"),
        (F.sum("breached") / F.sum("n")).alias("sos_breach_rate"))
    wasted = per_franchisee(
        last_days(waste, "logged_at", days, waste_as_of).groupBy("unit_id").agg(F.sum(fixed("waste_cost")).alias("w")),
        unit, (F.sum("w") / F.lit(10_000)).alias("waste_cost"))
    labor = per_franchisee(
        last_days(punches, "punch_in", days, labor_as_of).groupBy("unit_id").agg(F.sum(fixed("hours_worked")).alias("h")),
        unit, (F.sum("h") / F.lit(10_000)).alias("labor_hours"))
    return orders.join(wasted, "franchisee_id", "left").join(labor, "franchisee_id", "left").orderBy(F.desc("revenue"))


def tender_mix(payment, days=30, as_of=None):
    per_tender = last_days(payment, "paid_at", days, as_of).groupBy("tender_type").agg(
        rows().alias("payments"), F.sum(fixed("amount")).alias("cents"))
    # The window sees one row per tender type.
    total = F.sum("cents").over(Window.partitionBy())
    return per_tender.select("tender_type", "payments", (F.col("cents") / F.lit(10_000)).alias("amount"),
                             ratio(F.col("cents"), total).alias("pct_of_amount")).orderBy(F.desc("amount"))


def guest_churn(profiles, days=30, as_of=None):
    return last_days(profiles, "created_at", days, as_of).groupBy("unit_id").agg(
        rows().alias("total_profiles"), *[F.count_if(is_status(s)).alias(f"{s}_profiles")
                                          for s in ("active", "inactive", "suspended")],
        rate(is_status("inactive")).alias("inactive_rate")).orderBy(F.desc("inactive_rate"))
