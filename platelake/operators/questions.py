"""Named business questions, one function each.

Conventions: ``as_of`` is the clock (see :mod:`platelake.functions.clock`).  A
fact is summed on its own keys before it meets a dimension.  Windows appear only
over per-store, per-franchisee or per-tender results, whose row count is the
size of a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelake.functions.clock import last_days, month_to_date, since_date
from platelake.functions.numeric import favg, fixed, fsum, rate, ratio
from platelake.operators.tables import (below_par, earned, gap, is_late, is_status, item_sales, overtime_employees,
                                        per_franchisee, redeemed, rows, segment)

UNSCALE = 10_000


def top(df: DataFrame, n: int, by: str, *ties: str, ascending: bool = False) -> DataFrame:
    """First ``n`` rows by ``by``; ``ties`` make the cut repeatable."""
    first = F.asc(by) if ascending else F.desc(by)
    return df.orderBy(first, *ties).limit(n)


def money(c: str) -> Column:
    return F.sum(c) / F.lit(UNSCALE)


def week(ts: str) -> Column:
    return F.to_date(F.date_trunc("week", ts)).alias("week")


def month(ts: str) -> Column:
    return F.to_date(F.date_trunc("month", ts)).alias("month")


def in_metro(per_unit: DataFrame, unit: DataFrame) -> DataFrame:
    return per_unit.join(unit.select("unit_id", "metro_area"), "unit_id")


def spent(df: DataFrame, *keys) -> DataFrame:
    """Scaled revenue, orders and breaches per key."""
    return df.groupBy(*keys).agg(F.sum(fixed("total_amount")).alias("cents"), rows().alias("n"),
                                 F.count_if("sos_breach").alias("breached"))


# ---- orders and service

def cancellation_by_store(orders, as_of):
    cancelled = F.col("order_status") == "cancelled"
    return top(month_to_date(orders, "placed_at", as_of).groupBy("unit_id").agg(
        rate(cancelled).alias("cancellation_rate"), rows().alias("orders")), 20, "cancellation_rate", "unit_id")


def sos_by_hour(orders, as_of, days=14):
    return last_days(orders, "placed_at", days, as_of).groupBy(F.hour("placed_at").alias("hour_of_day")).agg(
        rate(F.col("sos_breach")).alias("sos_breach_rate"), rows().alias("orders")).orderBy("hour_of_day")


def delivery_gap(deliveries, as_of, days=30):
    return last_days(deliveries, "created_at", days, as_of).agg(F.avg(gap()).alias("avg_gap_seconds"))


def franchisee_revenue_month(orders, franchisee, as_of):
    per = spent(month_to_date(orders, "placed_at", as_of), "franchisee_id")
    return per.join(franchisee, "franchisee_id").groupBy("franchisee_name").agg(money("cents").alias("revenue")).orderBy(
        F.desc("revenue"))


def channel_revenue(orders, as_of, days=30):
    return last_days(orders, "placed_at", days, as_of).groupBy("channel").agg(
        rows().alias("orders"), fsum("total_amount").alias("revenue"), favg("total_amount").alias("aov")).orderBy(
        F.desc("revenue"))


def sos_by_channel(orders, as_of, days=14):
    return last_days(orders, "placed_at", days, as_of).groupBy("channel").agg(
        rate(F.col("sos_breach")).alias("sos_breach_rate"), rows().alias("orders"))


def gap_by_store(deliveries, as_of, days=30):
    return top(last_days(deliveries, "created_at", days, as_of).groupBy("unit_id").agg(
        F.avg(gap()).alias("avg_gap_seconds"), F.avg("actual_delivery_seconds").alias("avg_actual_seconds"),
        rows().alias("deliveries")), 20, "avg_gap_seconds", "unit_id")


def revenue_by_type(orders, as_of, days=30):
    return last_days(orders, "placed_at", days, as_of).groupBy("order_type").agg(
        fsum("total_amount").alias("revenue"), rows().alias("orders"),
        F.count_if(F.col("order_status") == "cancelled").alias("cancelled"),
        F.count_if(F.col("order_status") == "fulfilled").alias("fulfilled")).orderBy(F.desc("revenue"))


# ---- web orders

def reconciled_split(recon):
    return recon.groupBy("reconciled").agg(rows().alias("orders"), F.round(fsum("web_amount"), 2).alias("web_revenue"))


def reconcile_one(recon, web_order_id):
    return recon.filter(F.col("web_order_id") == web_order_id).select(
        "web_order_id", "guest_order_id", "reconciled", "web_amount", "silver_total_amount", "amount_diff")


def web_order_detail(header, items, web_order_id):
    lines = items.select("web_order_id", "menu_item_id", "item_name", "category", "quantity", "unit_price", "line_amount")
    return header.filter(F.col("web_order_id") == web_order_id).join(lines, "web_order_id", "left").select(
        "web_order_id", "web_store_id", "web_store_city", "web_store_state", "web_store_zip", "channel", "order_stage",
        "web_amount", "web_item_count", "web_total_quantity", "web_order_ts", "menu_item_id", "item_name", "category",
        "quantity", "unit_price", "line_amount", "member_id", "customer_matched", "customer_tier",
        "customer_total_orders", "customer_lifetime_spend").orderBy("menu_item_id")


def web_order_customer(header, web_order_id):
    return header.filter(F.col("web_order_id") == web_order_id).select(
        "web_order_id", "member_id", "customer_matched", "customer_tier", "customer_total_orders",
        "customer_lifetime_spend", "web_store_city", "web_store_state", "web_amount")


def matched_split(recon):
    return recon.groupBy("customer_matched").agg(rows().alias("orders"))


# ---- loyalty

def member_share_by_store(orders, as_of, days=30):
    return last_days(orders, "placed_at", days, as_of).groupBy("unit_id").agg(
        rate(F.col("member_id").isNotNull()).alias("member_order_share"), rows().alias("orders")).orderBy(
        F.desc("member_order_share"))


def breakage_by_tier(loyalty, as_of, days=30):
    return last_days(loyalty, "transaction_at", days, as_of).groupBy("tier").agg(
        (1 - ratio(redeemed(), earned())).alias("breakage_rate")).orderBy(F.desc("breakage_rate"))


def redemption_by_tier(loyalty, as_of, days=30):
    return last_days(loyalty, "transaction_at", days, as_of).groupBy("tier").agg(
        ratio(redeemed(), earned()).alias("redemption_rate")).orderBy("redemption_rate")


def active_members_weekly(loyalty, as_of, days=90):
    return last_days(loyalty, "transaction_at", days, as_of).groupBy(week("transaction_at")).agg(
        F.count_distinct("member_id").alias("active_members")).orderBy("week")


def redemptions_week(redemptions, as_of, days=7):
    return since_date(redemptions, "redeemed_at", days, as_of).agg(
        rows().alias("redemptions"), fsum("reward_value").alias("total_reward_value"))


def active_digital_accounts(accounts):
    return accounts.filter(is_status("active")).agg(rows().alias("active_digital_accounts"))


def engagement_by_franchisee(loyalty, as_of):
    return month_to_date(loyalty, "transaction_at", as_of).groupBy("franchisee_id").agg(
        F.count_distinct("member_id").alias("members"), rows().alias("transactions")).orderBy(F.desc("members"))


def earn_redeem_counts(loyalty, as_of, days=30):
    return last_days(loyalty, "transaction_at", days, as_of).groupBy("transaction_type").agg(rows().alias("transactions"))


# ---- inventory

def overproduction_share(waste, as_of, days=30):
    over = F.when(F.col("waste_category") == "overproduction", F.col("waste_cost")).otherwise(0.0)
    return last_days(waste, "logged_at", days, as_of).agg(ratio(fsum(over), fsum("waste_cost")).alias("overproduction_share"))


def receiving_failure(receipts, as_of, days=30):
    return last_days(receipts, "created_at", days, as_of).agg(
        rate(F.col("quality_inspection_result") != "pass").alias("quality_failure_rate"), rows().alias("receipts"))


def cold_chain(receipts, as_of, days=30):
    return last_days(receipts, "created_at", days, as_of).agg(
        rate(F.col("temperature_check_pass")).alias("cold_chain_compliance_rate"))


def open_pos(replenishments, status="open"):
    return replenishments.filter(F.col("order_status") == status).agg(rows().alias("open_pos"))


def bom_cost(recipe, menu_item, n=20):
    per_item = recipe.groupBy("menu_item_id").agg(
        F.sum(fixed(F.col("quantity") * F.col("cost_per_unit"))).alias("cents"))
    named = per_item.join(menu_item.select("menu_item_id", "item_name"), "menu_item_id").groupBy("item_name").agg(
        money("cents").alias("extended_ingredient_cost"))
    return top(named, n, "extended_ingredient_cost", "item_name")


def overproduction_weekly(waste):
    return waste.filter(F.col("waste_category") == "overproduction").groupBy(week("logged_at")).agg(
        fsum("waste_cost").alias("waste_cost"), rows().alias("events")).orderBy("week")


def overproduction_by_store(waste, as_of, days=30):
    over = last_days(waste, "logged_at", days, as_of).filter(F.col("waste_category") == "overproduction")
    return top(over.groupBy("unit_id").agg(fsum("waste_cost").alias("waste_cost")), 20, "waste_cost", "unit_id")


def waste_per_event(waste, as_of, days=30):
    return last_days(waste, "logged_at", days, as_of).groupBy("unit_id").agg(
        ratio(fsum("waste_cost"), rows()).alias("cost_per_event"), rows().alias("events"))


def waste_by_daypart(waste):
    h = F.hour("logged_at")
    band = (F.when(h < 10, "morning").when(h <= 14, "lunch").when(h <= 16, "afternoon").when(h <= 21, "dinner")
            .otherwise("late_night"))
    return waste.groupBy(band.alias("daypart")).agg(fsum("waste_cost").alias("waste_cost"), rows().alias("events"))


def most_below_par(on_hand):
    return below_par(on_hand).groupBy("unit_id").agg(rows().alias("skus_below_par"), fsum("shortfall").alias("shortfall")).orderBy(
        F.desc("skus_below_par"), "unit_id")


# ---- workforce

def labor_hours_week(punches, as_of, days=7):
    return since_date(punches, "punch_in", days, as_of).groupBy("unit_id").agg(
        fsum("hours_worked").alias("labor_hours")).orderBy(F.desc("labor_hours"))


def headcount_store(punches, unit_id, as_of):
    return month_to_date(punches.filter(F.col("unit_id") == unit_id), "punch_in", as_of).agg(
        F.count_distinct("employee_id").alias("employees"))


def shift_status(shifts, as_of, days=7):
    start = F.date_sub(F.to_date(as_of), days)
    return shifts.filter(F.col("date").cast("date") >= start).groupBy("status").agg(rows().alias("shifts"))


def shift_completion(shifts, as_of, days=7):
    start = F.date_sub(F.to_date(as_of), days)
    return shifts.filter(F.col("date").cast("date") >= start).agg(
        rate(F.col("status") == "completed").alias("completion_rate"), rows().alias("shifts"))


def headcount_franchisee(punches, as_of):
    return month_to_date(punches, "punch_in", as_of).groupBy("franchisee_id").agg(
        F.count_distinct("employee_id").alias("headcount")).orderBy(F.desc("headcount"))


def labor_per_order(punches, orders, labor_as_of, as_of, days=7):
    hours = since_date(punches, "punch_in", days, labor_as_of).groupBy("unit_id").agg(fsum("hours_worked").alias("hrs"))
    n = since_date(orders, "placed_at", days, as_of).groupBy("unit_id").agg(rows().alias("orders"))
    return hours.join(n, "unit_id").select("unit_id", ratio(F.col("hrs"), F.col("orders")).alias("labor_hours_per_order"))


def overtime_by_store(punches, as_of, days=7, limit_hours=40):
    over = overtime_employees(punches, days, as_of, limit_hours)
    return over.groupBy("unit_id").agg(fsum(F.col("hours") - limit_hours).alias("overtime_hours"), rows().alias("employees"))


def hours_per_shift(punches, as_of, days=7):
    return last_days(punches, "punch_in", days, as_of).groupBy("unit_id").agg(
        favg("hours_worked").alias("avg_hours"), rows().alias("punches"))


def top_employees(punches, as_of, days=7, n=20):
    return top(last_days(punches, "punch_in", days, as_of).groupBy("employee_id").agg(
        fsum("hours_worked").alias("hours")), n, "hours", "employee_id")


# ---- demand risk

def risk_units(outlook):
    return outlook.select("unit_id", "metro_area", "avg_demand_multiplier", "demand_risk_days", "capacity_risk_days").orderBy(
        F.desc("demand_risk_days"), "avg_demand_multiplier", "unit_id").limit(20)


def capacity_units(outlook):
    return outlook.filter(F.col("capacity_risk_days") > 0).select(
        "unit_id", "metro_area", "capacity_risk_days", "avg_demand_multiplier").orderBy(F.desc("capacity_risk_days"))


def ahead(df, day, today, days):
    return df.filter(F.col(day).between(today, F.date_add(today, days)))


def top_events(events, today, days=14):
    return top(ahead(events, "event_date", today, days).select(
        "event_name", "metro_area", "event_date", "event_category", "est_attendance", "est_demand_multiplier", "event_id"),
        20, "est_demand_multiplier", "event_id")


def events_by_attendance(events, today, days=14):
    return top(ahead(events, "event_date", today, days).select(
        "event_name", "metro_area", "event_date", "est_attendance", "event_id"), 20, "est_attendance", "event_id")


def weather_effect(weather, today):
    return weather.filter(F.col("forecast_date") >= today).groupBy("weather_condition").agg(
        favg("demand_multiplier").alias("avg_multiplier"), rows().alias("days")).orderBy(F.desc("avg_multiplier"))


def metro_risk_days(forecast, today, days=14):
    return ahead(forecast, "forecast_date", today, days).groupBy("metro_area").agg(
        F.count_if(F.col("risk_level") == "demand_risk").alias("demand_risk_days")).orderBy(F.desc("demand_risk_days"))


def metro_risk_split(forecast, today, days=7):
    return ahead(forecast, "forecast_date", today, days).groupBy("metro_area").agg(
        F.count_if(F.col("risk_level") == "demand_risk").alias("demand_risk_days"),
        F.count_if(F.col("risk_level") == "capacity_risk").alias("capacity_risk_days"))


def store_forecast(forecast, unit_id, today, days=7):
    return ahead(forecast, "forecast_date", today, days).filter(F.col("unit_id") == unit_id).select(
        "forecast_date", "weather_condition", "alert_level", "event_name", "combined_demand_multiplier", "risk_level")


def metro_daily_multiplier(forecast, metro, today, days=14):
    return ahead(forecast, "forecast_date", today, days).filter(F.col("metro_area") == metro).groupBy("forecast_date").agg(
        favg("combined_demand_multiplier").alias("avg_multiplier"))


def weather_alerts(forecast, today, days=14):
    return ahead(forecast, "forecast_date", today, days).filter(F.col("alert_level").isNotNull()).select(
        "unit_id", "metro_area", "forecast_date", "alert_level").distinct()


# ---- franchisees

def franchisee_stores(orders, unit, as_of):
    per_unit = spent(month_to_date(orders, "placed_at", as_of), "unit_id")
    return per_franchisee(per_unit, unit, F.count_distinct("unit_id").alias("stores"),
                          money("cents").alias("revenue")).orderBy(F.desc("revenue"))


def region_revenue(orders, unit, as_of):
    per_unit = spent(month_to_date(orders, "placed_at", as_of), "unit_id")
    return per_unit.join(unit.select("unit_id", "region_id"), "unit_id").groupBy("region_id").agg(
        money("cents").alias("revenue")).orderBy(F.desc("revenue"))


def franchisee_aov(orders, unit, as_of, days=30):
    per_unit = spent(last_days(orders, "placed_at", days, as_of), "unit_id")
    return per_franchisee(per_unit, unit, (money("cents") / F.sum("n")).alias("avg_order_value"), F.sum("n").alias("orders"))


def franchisee_monthly(orders, franchisee_id):
    return orders.filter(F.col("franchisee_id") == franchisee_id).groupBy(month("placed_at")).agg(
        fsum("total_amount").alias("revenue"), rows().alias("orders")).orderBy("month")


def franchisee_labor(card):
    return card.select("franchisee_id", ratio(F.col("labor_hours"), F.col("revenue")).alias("labor_per_revenue"),
                       ratio(F.col("revenue"), F.col("labor_hours")).alias("revenue_per_labor_hour"))


def top_bottom(card, n=5):
    """Best and worst franchisees by revenue."""
    best = Window.orderBy(F.desc("revenue"), "franchisee_id")
    worst = Window.orderBy("revenue", "franchisee_id")
    ranked = card.withColumn("from_top", F.row_number().over(best)).withColumn("from_bottom", F.row_number().over(worst))
    return ranked.filter((F.col("from_top") <= n) | (F.col("from_bottom") <= n)).select(
        "franchisee_id", "revenue", "from_top", "from_bottom")


def underperformers(card):
    """Franchisees in the lower half by revenue and the worse half by service."""
    low = F.percent_rank().over(Window.orderBy("revenue"))
    slow = F.percent_rank().over(Window.orderBy(F.desc("sos_breach_rate")))
    return card.select("franchisee_id", "revenue", "sos_breach_rate", low.alias("revenue_rank"), slow.alias("sos_rank")).filter(
        (F.col("revenue_rank") <= 0.5) & (F.col("sos_rank") <= 0.5))


# ---- delivery: order facts join on the order key, then totals per store meet the unit

def with_channel(facts, orders, *columns):
    return facts.join(orders.select("guest_order_id", *columns), "guest_order_id")


def gap_by_metro(deliveries, unit, as_of, days=30):
    per_unit = last_days(deliveries, "created_at", days, as_of).groupBy("unit_id").agg(
        F.sum(gap()).alias("g"), rows().alias("n"))
    return in_metro(per_unit, unit).groupBy("metro_area").agg((F.sum("g") / F.sum("n")).alias("avg_gap_seconds")).orderBy(
        F.desc("avg_gap_seconds"))


def late_by_channel(deliveries, orders, as_of, days=30):
    d = with_channel(last_days(deliveries, "created_at", days, as_of), orders, "channel")
    return d.filter(F.col("channel").isin("own_delivery", "3pd_delivery")).groupBy("channel").agg(
        rate(is_late()).alias("late_rate"), rows().alias("deliveries"))


def volume_by_channel(deliveries, orders, as_of, days=30):
    return with_channel(last_days(deliveries, "created_at", days, as_of), orders, "channel").groupBy("channel").agg(
        rows().alias("deliveries")).orderBy(F.desc("deliveries"))


def volume_by_metro(deliveries, unit, as_of, days=30):
    per_unit = last_days(deliveries, "created_at", days, as_of).groupBy("unit_id").agg(rows().alias("n"))
    return in_metro(per_unit, unit).groupBy("metro_area").agg(F.sum("n").alias("deliveries")).orderBy(F.desc("deliveries"))


def late_vs_ontime(deliveries, as_of, days=14):
    return last_days(deliveries, "created_at", days, as_of).groupBy(
        F.when(is_late(), "late").otherwise("on_time").alias("status")).agg(rows().alias("deliveries"))


def wow_late_rate(deliveries):
    """Stores whose late rate fell against their previous active week."""
    weekly = deliveries.groupBy("unit_id", week("created_at")).agg(rate(is_late()).alias("late_rate"))
    before = F.lag("late_rate").over(Window.partitionBy("unit_id").orderBy("week"))
    return weekly.withColumn("previous_rate", before).filter(F.col("late_rate") < F.col("previous_rate"))


def delivery_share(orders, as_of, days=30):
    per_type = last_days(orders, "placed_at", days, as_of).groupBy("order_type").agg(rows().alias("orders"))
    return per_type.withColumn("share", ratio(F.col("orders"), F.sum("orders").over(Window.partitionBy())))


# ---- menu

def gross_margin(menu_item, n=20):
    margin = (fixed("base_price") - fixed("cost")) / F.lit(UNSCALE)
    return top(menu_item.select("menu_item_id", "item_name", "category", "base_price", "cost", margin.alias("gross_margin"),
                                ratio(margin, F.col("base_price")).alias("margin_pct")), n, "gross_margin", "menu_item_id")


def low_margin(menu_item, n=20):
    margin = (fixed("base_price") - fixed("cost")) / F.lit(UNSCALE)
    return top(menu_item.select("menu_item_id", "item_name", margin.alias("gross_margin")), n, "gross_margin", "menu_item_id",
               ascending=True)


def category_prices(menu_item):
    return menu_item.groupBy("category").agg(favg("base_price").alias("avg_price"), favg("cost").alias("avg_cost"))


def menu_group(order_item, menu_item, group, as_of, days=30):
    """Units and revenue per menu attribute, from per-item totals."""
    sold = item_sales(order_item, days=days, as_of=as_of)
    return sold.join(menu_item.select("menu_item_id", group), "menu_item_id").groupBy(group).agg(
        F.sum("units_sold").alias("units_sold"), money("net").alias("revenue"))


def category_share(order_item, menu_item, as_of, days=30):
    per = menu_group(order_item, menu_item, "category", as_of, days)
    return per.select("category", "revenue", ratio(
        fixed("revenue"), F.sum(fixed("revenue")).over(Window.partitionBy())).alias("share"))


def top_items_units(order_item, menu_item, as_of, days=30, n=10, by="units_sold"):
    sold = item_sales(order_item, days=days, as_of=as_of).withColumn("revenue", F.col("net") / F.lit(UNSCALE)).drop("net")
    best = top(sold, n, by, "menu_item_id")
    return best.join(menu_item.select("menu_item_id", "item_name"), "menu_item_id")


def price_drift_trend(item_price, periods):
    per = item_price.groupBy("financial_period_id").agg(F.sum(fixed("price_multiplier")).alias("m"), rows().alias("n"))
    return per.join(periods, "financial_period_id").groupBy("period_name", "start_date").agg(
        (F.sum("m") / F.lit(UNSCALE) / F.sum("n")).alias("avg_price_multiplier")).orderBy("start_date").drop("start_date")


def item_price_trend(item_price, periods, menu_item_id):
    return item_price.filter(F.col("menu_item_id") == menu_item_id).join(
        periods.select("financial_period_id", "period_name", "start_date"), "financial_period_id").select(
        "period_name", "start_date", "price_multiplier").orderBy("start_date")


def channel_availability(menu_item):
    return menu_item.filter(F.col("is_3pd_available") & ~F.col("is_carryout_available")).select(
        "menu_item_id", "item_name", "category")


# ---- payments

def tender_by_channel(payments, orders, as_of, days=30):
    return with_channel(last_days(payments, "paid_at", days, as_of), orders, "channel").groupBy(
        "channel", "tender_type").agg(fsum("amount").alias("amount"), rows().alias("payments"))


def share_of_tender(tender):
    part = F.when(F.col("tender_type") == tender, F.col("amount")).otherwise(0.0)
    return ratio(fsum(part), fsum("amount"))


def wallet_weekly(payments, as_of, days=90):
    return last_days(payments, "paid_at", days, as_of).groupBy(week("paid_at")).agg(
        share_of_tender("digital_wallet").alias("digital_wallet_share")).orderBy("week")


def wallet_by_store(payments, as_of, days=30):
    return top(last_days(payments, "paid_at", days, as_of).groupBy("unit_id").agg(
        share_of_tender("digital_wallet").alias("digital_wallet_share")), 20, "digital_wallet_share", "unit_id")


def avg_payment(payments, as_of, days=30):
    return last_days(payments, "paid_at", days, as_of).groupBy("tender_type").agg(
        favg("amount").alias("avg_amount"), rows().alias("payments")).orderBy(F.desc("avg_amount"))


def tender_by_segment(payments, orders, as_of, days=30):
    return with_channel(last_days(payments, "paid_at", days, as_of), orders, "member_id").groupBy(
        segment().alias("segment"), "tender_type").agg(fsum("amount").alias("amount"))


def payments_month(payments, as_of):
    return month_to_date(payments, "paid_at", as_of).groupBy("tender_type").agg(rows().alias("payments"))


def tender_share(payments, as_of, days=30):
    return last_days(payments, "paid_at", days, as_of).agg(
        share_of_tender("digital_wallet").alias("wallet_share"),
        share_of_tender("loyalty_redemption").alias("redemption_share"))


def settled_by_tender(payments):
    return payments.filter(F.col("settlement_date").isNotNull()).groupBy("tender_type").agg(
        fsum("amount").alias("settled"))


def cash_by_metro(payments, unit, as_of, days=30):
    per_unit = last_days(payments, "paid_at", days, as_of).filter(F.col("tender_type") == "cash").groupBy("unit_id").agg(
        F.sum(fixed("amount")).alias("cents"))
    return in_metro(per_unit, unit).groupBy("metro_area").agg(money("cents").alias("cash_amount"))


def cash_monthly(payments):
    return payments.groupBy(month("paid_at")).agg(share_of_tender("cash").alias("cash_share")).orderBy("month")


# ---- guests

def profiles_by_status(profiles):
    return profiles.groupBy("account_status").agg(rows().alias("profiles")).orderBy(F.desc("profiles"))


def digital_adoption(profiles, accounts):
    """Share of a store's profiles with an active digital account.

    Accounts are reduced to one row per profile first, so profile rows never fan out.
    """
    active = accounts.filter(is_status("active")).select("guest_profile_id").distinct().withColumn("digital", F.lit(True))
    return profiles.select("unit_id", "guest_profile_id").distinct().join(active, "guest_profile_id", "left").groupBy(
        "unit_id").agg(ratio(F.count("digital"), rows()).alias("digital_adoption_rate")).orderBy(F.desc("digital_adoption_rate"))


def new_profiles_month(profiles, as_of):
    return month_to_date(profiles, "created_at", as_of).agg(rows().alias("new_profiles"))


def registrations_weekly(profiles, as_of, days=90):
    return last_days(profiles, "created_at", days, as_of).groupBy(week("created_at")).agg(
        rows().alias("new_profiles")).orderBy("week")


def suspended_by_metro(profiles, unit):
    per_unit = profiles.filter(is_status("suspended")).groupBy("unit_id").agg(rows().alias("n"))
    return in_metro(per_unit, unit).groupBy("metro_area").agg(F.sum("n").alias("suspended")).orderBy(F.desc("suspended"))


def active_digital_by_store(profiles, accounts):
    per_profile = accounts.filter(is_status("active")).groupBy("guest_profile_id").agg(rows().alias("n"))
    return profiles.select("guest_profile_id", "unit_id").join(per_profile, "guest_profile_id").groupBy("unit_id").agg(
        F.sum("n").alias("active_digital_accounts")).orderBy(F.desc("active_digital_accounts"))


def active_share_franchisee(profiles):
    return profiles.groupBy("franchisee_id").agg(rate(is_status("active")).alias("active_share"), rows().alias("profiles"))


def new_guests_by_store(profiles, as_of, days=30):
    return top(last_days(profiles, "created_at", days, as_of).groupBy("unit_id").agg(rows().alias("new_profiles")),
               20, "new_profiles", "unit_id")


def digital_ratio(profiles, accounts):
    per_profile = accounts.groupBy("guest_profile_id").agg(rows().alias("n"))
    return profiles.select("guest_profile_id", "unit_id").join(per_profile, "guest_profile_id", "left").groupBy("unit_id").agg(
        ratio(F.coalesce(F.sum("n"), F.lit(0)), rows()).alias("accounts_per_profile"))


def guests_without_orders(profiles, orders):
    buyers = orders.filter(F.col("profile_id").isNotNull()).select(F.col("profile_id").alias("guest_profile_id")).distinct()
    return profiles.join(buyers, "guest_profile_id", "left_anti").groupBy("account_status").agg(rows().alias("guests"))


# ---- customers

def churn_risk(features, n=50):
    return top(features.filter(F.col("recency_days") >= 0).select(
        "profile_id", "recency_days", "total_orders", "monetary_total", "tier"), n, "recency_days", "profile_id")


def value_by_tier(features):
    return features.groupBy("tier").agg(favg("monetary_total").alias("avg_lifetime_spend"), favg("aov").alias("avg_aov"),
                                        rows().alias("customers")).orderBy(F.desc("avg_lifetime_spend"))


def never_ordered(features):
    return features.filter(F.col("recency_days") == -1).agg(rows().alias("never_ordered"))


def affinity_by_tier(features, category="pizza"):
    return features.groupBy("tier").agg(favg(f"affinity_{category}", 1_000_000).alias(f"avg_{category}_affinity"))


def top_customers(features, n=20):
    return top(features.select("profile_id", "monetary_total", "total_orders", "aov", "tier"), n, "monetary_total", "profile_id")


def tier_distribution(features):
    return features.groupBy("tier").agg(rows().alias("customers"))


def frequent_customers(features, n=20):
    return top(features.select("profile_id", "total_orders", "monetary_total"), n, "total_orders", "profile_id")


def recency_by_tier(features):
    seen = F.when(F.col("recency_days") >= 0, F.col("recency_days"))
    return features.groupBy("tier").agg(F.avg(seen).alias("avg_recency_days"))


def mean_affinities(features, categories):
    return features.agg(*[favg(f"affinity_{c}", 1_000_000).alias(f"avg_{c}") for c in categories])


def stores_by_aov(stores, n=20):
    return top(stores.select("unit_id", "store_orders", "store_aov"), n, "store_aov", "unit_id")


def top_decile_customers(features, groups=10):
    """Customers and spend in the top spend decile.

    A customer is in it when fewer than a tenth of all customers spent more.
    Customers are first counted per distinct spend; the running count over those
    values is cut into ranges whose totals are shifted, so no single task sorts
    all customers.
    """
    levels = features.groupBy(fixed("monetary_total").alias("v")).agg(rows().alias("n"))
    cuts = levels.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)])).scalar()
    span = levels.withColumn("cuts", cuts).withColumn("span", F.aggregate("cuts", F.lit(0), lambda a, c: a + F.when(c < F.col("v"), 1).otherwise(0)))
    totals = span.groupBy("span").agg(F.sum("n").alias("t"))
    above = F.coalesce(F.sum("t").over(Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("span").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = span.join(totals.select("span", above.alias("above")), "span").withColumn(
        "richer", F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    everyone = levels.agg(F.sum("n")).scalar()
    head = F.col("richer") * groups < everyone
    return ranked.agg(
        F.sum(F.when(head, F.col("n")).otherwise(0)).alias("customers"),
        (F.sum(F.when(head, F.col("n")).otherwise(0)) / F.sum("n")).alias("customer_share"),
        (F.sum(F.when(head, F.col("v") * F.col("n")).otherwise(0)) / F.sum(F.col("v") * F.col("n"))).alias("spend_share"))


# ---- cross-domain views over per-store results

def member_aov_by_store(orders, as_of, days=90):
    return last_days(orders, "placed_at", days, as_of).groupBy("unit_id").agg(
        rate(F.col("member_id").isNotNull()).alias("member_share"), favg("total_amount").alias("aov"))


def member_aov_corr(per_store):
    return per_store.agg(F.round(F.corr("member_share", "aov"), 6).alias("correlation"), rows().alias("stores"))


def member_share_quintiles(per_store):
    group = F.ntile(5).over(Window.orderBy("member_share", "unit_id"))
    return per_store.withColumn("quintile", group).groupBy("quintile").agg(
        rows().alias("stores"), F.round(F.avg("aov"), 4).alias("avg_aov"))


def labor_quartile_sos(punches, orders, labor_as_of, as_of, days=30):
    labor = labor_per_order(punches, orders, labor_as_of, as_of, days)
    service = since_date(orders, "placed_at", days, as_of).groupBy("unit_id").agg(
        F.count_if("sos_breach").alias("breached"), rows().alias("n"))
    group = F.ntile(4).over(Window.orderBy("labor_hours_per_order", "unit_id"))
    return labor.withColumn("quartile", group).join(service, "unit_id").groupBy("quartile").agg(
        rows().alias("stores"), (F.sum("breached") / F.sum("n")).alias("sos_breach_rate"))


def daily_trend(orders, deliveries, punches, waste, unit_id):
    """Revenue, late rate, labour and waste of one store by day; a day appears if any of them has rows."""
    one = F.col("unit_id") == unit_id
    day = lambda ts: F.to_date(ts).alias("date")
    sales = orders.filter(one).groupBy(day("placed_at")).agg(fsum("total_amount").alias("revenue"))
    late = deliveries.filter(one).groupBy(day("created_at")).agg(rate(is_late()).alias("late_rate"))
    labor = punches.filter(one).groupBy(day("punch_in")).agg(fsum("hours_worked").alias("labor_hours"))
    lost = waste.filter(one).groupBy(day("logged_at")).agg(fsum("waste_cost").alias("waste_cost"))
    return sales.join(late, "date", "full").join(labor, "date", "full").join(lost, "date", "full")


def belowpar_vs_waste(on_hand, waste):
    short = below_par(on_hand).groupBy("unit_id").agg(rows().alias("skus_below_par"))
    lost = waste.groupBy("unit_id").agg(fsum("waste_cost").alias("waste_cost"))
    return lost.join(short, "unit_id", "left").select("unit_id", F.coalesce("skus_below_par", F.lit(0)).alias("skus_below_par"),
                                                      "waste_cost")


def productivity_vs_breach(productivity, service):
    return productivity.select("unit_id", "sales_per_labor_hour").join(
        service.select("unit_id", "sos_breach_rate"), "unit_id")


def overtime_vs_breach(overtime, service):
    return service.select("unit_id", "sos_breach_rate").join(overtime, "unit_id", "left").select(
        "unit_id", "sos_breach_rate", F.coalesce("overtime_hours", F.lit(0.0)).alias("overtime_hours"))
