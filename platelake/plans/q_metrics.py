"""Metric-view queries: one representative selection per view."""

from __future__ import annotations

from platelake.plans import metrics
from platelake.plans.duck import A, BURN, C, EARN, GAP, I, LATE, P, S
from platelake.plans.registry import query


def _select(key, view, dims, measures, sql, text=(), where=None):
    query(key, sql, text)(lambda t: view(t).query(dims, measures, where))


_select("mv_order_performance", metrics.order_performance,
        ["Unit ID", "Channel", "Order Type", "Order Month"],
        ["Total Orders", "Total Revenue", "Average Order Value", "Fulfilled Orders", "Cancelled Orders", "Total Discount",
         "SOS Breach Rate"],
        f"""SELECT unit_id "Unit ID", channel "Channel", order_type "Order Type",
        CAST(date_trunc('month',placed_at) AS DATE) "Order Month", count(*) "Total Orders", {S('total_amount')} "Total Revenue",
        {S('total_amount')}/count(*) "Average Order Value", {C("order_status='fulfilled'")} "Fulfilled Orders",
        {C("order_status='cancelled'")} "Cancelled Orders", {S('discount_amount')} "Total Discount",
        {I('CAST(sos_breach AS INT)')}/count(*) "SOS Breach Rate" FROM guest_order GROUP BY ALL""", ("Order Month",))
_select("mv_order_performance_by_status", metrics.order_performance, ["Order Status", "Order Date"], ["Total Orders"],
        """SELECT order_status "Order Status", CAST(placed_at AS DATE) "Order Date", count(*) "Total Orders"
        FROM guest_order WHERE channel='catering' GROUP BY ALL""", ("Order Date",),
        {"Channel": lambda c: c == "catering"})
_select("mv_loyalty_performance", metrics.loyalty_performance, ["Tier", "Transaction Type", "Unit ID", "Transaction Month"],
        ["Unique Members", "Total Transactions", "Points Earned", "Points Redeemed"],
        f"""SELECT tier "Tier", transaction_type "Transaction Type", unit_id "Unit ID",
        CAST(date_trunc('month',transaction_at) AS DATE) "Transaction Month", count(DISTINCT member_id) "Unique Members",
        count(*) "Total Transactions", {I("CASE WHEN transaction_type='earn' THEN points_delta ELSE 0 END")} "Points Earned",
        {I("CASE WHEN transaction_type='redeem' THEN abs(points_delta) ELSE 0 END")} "Points Redeemed"
        FROM loyalty_transaction GROUP BY ALL""", ("Transaction Month",))
_select("mv_inventory_waste", metrics.inventory_waste, ["Unit ID", "Stock SKU", "Waste Category", "Waste Week"],
        ["Total Waste Quantity", "Total Waste Cost", "Waste Events", "Average Waste Cost per Event"],
        f"""SELECT unit_id "Unit ID", stock_sku "Stock SKU", waste_category "Waste Category",
        CAST(date_trunc('week',logged_at) AS DATE) "Waste Week", {S('waste_quantity')} "Total Waste Quantity",
        {S('waste_cost')} "Total Waste Cost", count(*) "Waste Events", {S('waste_cost')}/count(*) "Average Waste Cost per Event"
        FROM waste_log GROUP BY ALL""", ("Waste Week",))
_select("mv_staff_hours", metrics.staff_hours, ["Unit ID", "Shift Date"],
        ["Total Hours Worked", "Total Shifts", "Unique Employees", "Average Hours per Shift"],
        f"""SELECT unit_id "Unit ID", CAST(punch_in AS DATE) "Shift Date", {S('hours_worked')} "Total Hours Worked",
        count(*) "Total Shifts", count(DISTINCT employee_id) "Unique Employees",
        {S('hours_worked')}/count(*) "Average Hours per Shift" FROM time_punch GROUP BY ALL""", ("Shift Date",))
_select("metric_orders_sos", metrics.orders_sos, ["Channel", "Store", "Metro", "State"],
        ["Orders", "Revenue", "Average Order Value", "SOS Breach Rate", "Cancellation Rate"],
        f"""SELECT channel "Channel", unit_name "Store", metro_area "Metro", state "State", count(*) "Orders",
        {S('total_amount')} "Revenue", {A('total_amount')} "Average Order Value", {P('sos_breach')} "SOS Breach Rate",
        {P("order_status='cancelled'")} "Cancellation Rate" FROM guest_order LEFT JOIN unit USING (unit_id) GROUP BY ALL""")
_select("metric_orders_sos_by_date", metrics.orders_sos, ["Order Date", "Order Type"], ["Orders", "Revenue"],
        f"""SELECT CAST(placed_at AS DATE) "Order Date", order_type "Order Type", count(*) "Orders",
        {S('total_amount')} "Revenue" FROM guest_order LEFT JOIN unit USING (unit_id) WHERE metro_area='ASIA' GROUP BY ALL""",
        ("Order Date",), {"Metro": lambda c: c == "ASIA"})
_select("metric_loyalty", metrics.loyalty, ["Tier", "Store", "Metro"],
        ["Active Members", "Transactions", "Points Earned", "Points Redeemed", "Redemption Rate"],
        f"""SELECT tier "Tier", unit_name "Store", metro_area "Metro", count(DISTINCT member_id) "Active Members",
        count(*) "Transactions", {I(EARN)} "Points Earned", {I(BURN)} "Points Redeemed",
        {I(BURN)}/nullif({I(EARN)},0) "Redemption Rate" FROM loyalty_transaction LEFT JOIN unit USING (unit_id) GROUP BY ALL""")
_select("metric_waste", metrics.waste, ["Waste Date", "Waste Category", "Metro"],
        ["Waste Cost", "Waste Quantity", "Waste Events", "Avg Cost per Event"],
        f"""SELECT CAST(logged_at AS DATE) "Waste Date", waste_category "Waste Category", metro_area "Metro",
        {S('waste_cost')} "Waste Cost", {S('waste_quantity')} "Waste Quantity", count(*) "Waste Events",
        {S('waste_cost')}/nullif(count(*),0) "Avg Cost per Event" FROM waste_log LEFT JOIN unit USING (unit_id) GROUP BY ALL""",
        ("Waste Date",))
_select("metric_labor", metrics.labor, ["Work Date", "Store", "Metro"],
        ["Labor Hours", "Employees", "Punches", "Avg Hours per Punch"],
        f"""SELECT CAST(punch_in AS DATE) "Work Date", unit_name "Store", metro_area "Metro", {S('hours_worked')} "Labor Hours",
        count(DISTINCT employee_id) "Employees", count(*) "Punches", {A('hours_worked')} "Avg Hours per Punch"
        FROM time_punch LEFT JOIN unit USING (unit_id) GROUP BY ALL""", ("Work Date",))
_select("metric_franchisee", metrics.franchisee, ["Franchisee", "Metro", "Region"],
        ["Revenue", "Orders", "Average Order Value", "SOS Breach Rate", "Stores"],
        f"""SELECT franchisee_name "Franchisee", metro_area "Metro", u.region_id "Region", {S('total_amount')} "Revenue",
        count(*) "Orders", {A('total_amount')} "Average Order Value", {P('sos_breach')} "SOS Breach Rate",
        count(DISTINCT g.unit_id) "Stores" FROM guest_order g LEFT JOIN unit u ON u.unit_id=g.unit_id
        LEFT JOIN franchisee f ON f.franchisee_id=g.franchisee_id GROUP BY ALL""")
_select("metric_delivery", metrics.delivery, ["Channel", "Store", "Metro"],
        ["Deliveries", "Late Deliveries", "Late Delivery Rate", "Avg Delivery Gap Seconds"],
        f"""SELECT channel "Channel", unit_name "Store", metro_area "Metro", count(*) "Deliveries", {C(LATE)} "Late Deliveries",
        {P(LATE)} "Late Delivery Rate", avg({GAP}) "Avg Delivery Gap Seconds" FROM delivery_order d
        LEFT JOIN guest_order g ON g.guest_order_id=d.guest_order_id LEFT JOIN unit u ON u.unit_id=d.unit_id GROUP BY ALL""")
_select("metric_menu", metrics.menu, ["Category", "Daypart", "Store"], ["Units Sold", "Net Revenue", "Line Items"],
        f"""SELECT category "Category", daypart "Daypart", unit_name "Store", {I('quantity')} "Units Sold",
        {S('line_net_amount')} "Net Revenue", count(*) "Line Items" FROM order_item LEFT JOIN menu_item USING (menu_item_id)
        LEFT JOIN unit USING (unit_id) GROUP BY ALL""")
_select("metric_payments", metrics.payments, ["Tender Type", "Channel", "Metro"],
        ["Payment Amount", "Payments", "Average Payment"],
        f"""SELECT tender_type "Tender Type", channel "Channel", metro_area "Metro", {S('amount')} "Payment Amount",
        count(*) "Payments", {A('amount')} "Average Payment" FROM payment p LEFT JOIN guest_order g
        ON g.guest_order_id=p.guest_order_id LEFT JOIN unit u ON u.unit_id=p.unit_id GROUP BY ALL""")
_select("metric_guest", metrics.guest, ["Created Date", "Account Status", "Metro"],
        ["Profiles", "Active Profiles", "Inactive Profiles", "Churn Rate"],
        f"""SELECT CAST(created_at AS DATE) "Created Date", account_status "Account Status", metro_area "Metro",
        count(*) "Profiles", {C("account_status='active'")} "Active Profiles", {C("account_status='inactive'")}
        "Inactive Profiles", {P("account_status='inactive'")} "Churn Rate" FROM guest_profile LEFT JOIN unit USING (unit_id)
        GROUP BY ALL""", ("Created Date",))
_select("metric_demand_risk", metrics.demand_risk, ["Forecast Date", "Metro", "Risk Level", "Weather Condition"],
        ["Avg Demand Multiplier", "Demand Risk Days", "Capacity Risk Days", "Store Days"],
        f"""SELECT forecast_date "Forecast Date", metro_area "Metro", risk_level "Risk Level",
        weather_condition "Weather Condition", {A('combined_demand_multiplier')} "Avg Demand Multiplier",
        {C("risk_level='demand_risk'")} "Demand Risk Days", {C("risk_level='capacity_risk'")} "Capacity Risk Days",
        count(*) "Store Days" FROM demand_risk_forecast GROUP BY ALL""", ("Forecast Date",))
_select("metric_customer", metrics.customer, ["Tier"],
        ["Customers", "Avg Lifetime Spend", "Avg Order Value", "Avg Recency Days", "Avg Total Orders"],
        f"""SELECT tier "Tier", count(*) "Customers", {A('monetary_total')} "Avg Lifetime Spend", {A('aov')} "Avg Order Value",
        avg(CASE WHEN recency_days>=0 THEN recency_days END) "Avg Recency Days", avg(total_orders) "Avg Total Orders"
        FROM customer_features GROUP BY ALL""")
