"""The fifteen metric views over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platelake.operators.metric_view import (Field, Join, MetricView, count_of, count_rows, distinct, mean, mean_money, money, share,
                                             total)
from platelake.operators.tables import gap, is_late, is_status


def _month(ts):
    return F.to_date(F.date_trunc("month", ts))


def _unit_join(t):
    return Join(t.unit, "unit_id", {"u_name": "unit_name", "u_metro": "metro_area", "u_state": "state",
                                    "u_region": "region_id"})


def _of_unit(column):
    return Field(F.col(column), ["unit"])


def _points(sign):
    """Points earned (1) or redeemed (-1)."""
    moved = F.col("points_delta") * sign
    return total(F.when(moved > 0, moved).otherwise(0))


def order_performance(t):
    return MetricView(
        t.guest_order,
        {"Unit ID": F.col("unit_id"), "Channel": F.col("channel"), "Order Type": F.col("order_type"),
         "Order Status": F.col("order_status"), "Order Date": F.to_date("placed_at"), "Order Month": _month("placed_at")},
        {"Total Orders": count_rows(), "Total Revenue": money("total_amount"), "Average Order Value": money("total_amount") / count_rows(),
         "Fulfilled Orders": count_of(F.col("order_status") == "fulfilled"),
         "Cancelled Orders": count_of(F.col("order_status") == "cancelled"),
         "Total Discount": money("discount_amount"), "SOS Breach Rate": total(F.col("sos_breach").cast("int")) / count_rows()})


def loyalty_performance(t):
    kind, points = F.col("transaction_type"), F.col("points_delta")
    return MetricView(
        t.loyalty_transaction,
        {"Tier": F.col("tier"), "Transaction Type": kind, "Unit ID": F.col("unit_id"),
         "Transaction Month": _month("transaction_at")},
        {"Unique Members": distinct("member_id"), "Total Transactions": count_rows(),
         "Points Earned": total(F.when(kind == "earn", points).otherwise(0)),
         "Points Redeemed": total(F.when(kind == "redeem", F.abs(points)).otherwise(0))})


def inventory_waste(t):
    return MetricView(
        t.waste_log,
        {"Unit ID": F.col("unit_id"), "Stock SKU": F.col("stock_sku"), "Waste Category": F.col("waste_category"),
         "Waste Week": F.to_date(F.date_trunc("week", "logged_at")), "Waste Month": _month("logged_at")},
        {"Total Waste Quantity": money("waste_quantity"), "Total Waste Cost": money("waste_cost"), "Waste Events": count_rows(),
         "Average Waste Cost per Event": money("waste_cost") / count_rows()})


def staff_hours(t):
    return MetricView(
        t.time_punch,
        {"Unit ID": F.col("unit_id"), "Shift Date": F.to_date("punch_in"), "Shift Month": _month("punch_in")},
        {"Total Hours Worked": money("hours_worked"), "Total Shifts": count_rows(),
         "Unique Employees": distinct("employee_id"), "Average Hours per Shift": money("hours_worked") / count_rows()})


def orders_sos(t):
    return MetricView(
        t.guest_order,
        {"Order Date": F.to_date("placed_at"), "Channel": F.col("channel"), "Order Type": F.col("order_type"),
         "Store": _of_unit("u_name"), "Metro": _of_unit("u_metro"), "State": _of_unit("u_state")},
        {"Orders": count_rows(), "Revenue": money("total_amount"), "Average Order Value": mean_money("total_amount"),
         "SOS Breach Rate": share(F.col("sos_breach")), "Cancellation Rate": share(F.col("order_status") == "cancelled")},
        {"unit": _unit_join(t)})


def loyalty(t):
    return MetricView(
        t.loyalty_transaction,
        {"Transaction Date": F.to_date("transaction_at"), "Tier": F.col("tier"), "Store": _of_unit("u_name"), "Metro": _of_unit("u_metro")},
        {"Active Members": distinct("member_id"), "Transactions": count_rows(), "Points Earned": _points(1),
         "Points Redeemed": _points(-1), "Redemption Rate": _points(-1) / _points(1)},
        {"unit": _unit_join(t)})


def waste(t):
    return MetricView(
        t.waste_log,
        {"Waste Date": F.to_date("logged_at"), "Waste Category": F.col("waste_category"), "Store": _of_unit("u_name"), "Metro": _of_unit("u_metro")},
        {"Waste Cost": money("waste_cost"), "Waste Quantity": money("waste_quantity"), "Waste Events": count_rows(),
         "Avg Cost per Event": money("waste_cost") / count_rows()},
        {"unit": _unit_join(t)})


def labor(t):
    return MetricView(
        t.time_punch,
        {"Work Date": F.to_date("punch_in"), "Store": _of_unit("u_name"), "Metro": _of_unit("u_metro")},
        {"Labor Hours": money("hours_worked"), "Employees": distinct("employee_id"), "Punches": count_rows(),
         "Avg Hours per Punch": mean_money("hours_worked")},
        {"unit": _unit_join(t)})


def franchisee(t):
    return MetricView(
        t.guest_order,
        {"Order Date": F.to_date("placed_at"), "Franchisee": Field(F.col("f_name"), ["franchisee"]), "Store": _of_unit("u_name"),
         "Metro": _of_unit("u_metro"), "Region": _of_unit("u_region")},
        {"Revenue": money("total_amount"), "Orders": count_rows(), "Average Order Value": mean_money("total_amount"),
         "SOS Breach Rate": share(F.col("sos_breach")),
         "Stores": Field(distinct(F.when(F.col("u_name").isNotNull(), F.col("unit_id"))), ["unit"])},
        {"unit": _unit_join(t), "franchisee": Join(t.franchisee, "franchisee_id", {"f_name": "franchisee_name"})})


def delivery(t):
    return MetricView(
        t.delivery_order,
        {"Delivery Date": F.to_date("created_at"), "Channel": Field(F.col("o_channel"), ["guest_order"]),
         "Store": _of_unit("u_name"), "Metro": _of_unit("u_metro")},
        {"Deliveries": count_rows(), "Late Deliveries": count_of(is_late()), "Late Delivery Rate": share(is_late()),
         "Avg Delivery Gap Seconds": mean(gap())},
        {"unit": _unit_join(t), "guest_order": Join(t.guest_order, "guest_order_id", {"o_channel": "channel"}, fine=True)})


def menu(t):
    item = lambda c: Field(F.col(c), ["menu_item"])
    return MetricView(
        t.order_item,
        {"Order Date": F.to_date("placed_at"), "Item": item("i_name"), "Category": item("i_category"),
         "Daypart": item("i_daypart"), "Store": _of_unit("u_name")},
        {"Units Sold": total("quantity"), "Net Revenue": money("line_net_amount"), "Line Items": count_rows()},
        {"unit": _unit_join(t),
         "menu_item": Join(t.menu_item, "menu_item_id", {"i_name": "item_name", "i_category": "category",
                                                         "i_daypart": "daypart"})})


def payments(t):
    return MetricView(
        t.payment,
        {"Payment Date": F.to_date("paid_at"), "Tender Type": F.col("tender_type"),
         "Channel": Field(F.col("o_channel"), ["guest_order"]), "Store": _of_unit("u_name"), "Metro": _of_unit("u_metro")},
        {"Payment Amount": money("amount"), "Payments": count_rows(), "Average Payment": mean_money("amount")},
        {"unit": _unit_join(t), "guest_order": Join(t.guest_order, "guest_order_id", {"o_channel": "channel"}, fine=True)})


def guest(t):
    return MetricView(
        t.guest_profile,
        {"Created Date": F.to_date("created_at"), "Account Status": F.col("account_status"), "Store": _of_unit("u_name"),
         "Metro": _of_unit("u_metro")},
        {"Profiles": count_rows(), "Active Profiles": count_of(is_status("active")),
         "Inactive Profiles": count_of(is_status("inactive")), "Churn Rate": share(is_status("inactive"))},
        {"unit": _unit_join(t)})


def demand_risk(t):
    return MetricView(
        t.demand_risk_forecast,
        {"Forecast Date": F.col("forecast_date"), "Metro": F.col("metro_area"), "Risk Level": F.col("risk_level"),
         "Weather Condition": F.col("weather_condition")},
        {"Avg Demand Multiplier": mean_money("combined_demand_multiplier"),
         "Demand Risk Days": count_of(F.col("risk_level") == "demand_risk"),
         "Capacity Risk Days": count_of(F.col("risk_level") == "capacity_risk"), "Store Days": count_rows()})


def customer(t):
    seen = F.when(F.col("recency_days") >= 0, F.col("recency_days"))
    return MetricView(
        t.customer_features, {"Tier": F.col("tier")},
        {"Customers": count_rows(), "Avg Lifetime Spend": mean_money("monetary_total"), "Avg Order Value": mean_money("aov"),
         "Avg Recency Days": mean(seen), "Avg Total Orders": mean("total_orders")})
