"""Named business questions over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from platelake.operators import gold, questions as q, tables
from platelake.operators.features import CATEGORIES
from platelake.plans.duck import (A, C, EARN, BURN, GAP, I, LATE, NOW_DEL, NOW_EVT, NOW_LOY, NOW_ORD, NOW_PAY, NOW_RCV,
                                  NOW_WST, P, R, S, TODAY, days, fx)
from platelake.plans.q_tables import scorecard
from platelake.plans.registry import query

ORD30 = f"placed_at>={NOW_ORD}-{days(30)}"
ORD_MONTH = f"placed_at>=date_trunc('month',{NOW_ORD})"
PAY30 = f"paid_at>={NOW_PAY}-{days(30)}"
DEL30 = f"d.created_at>={NOW_DEL}-{days(30)}"
WST30 = f"logged_at>={NOW_WST}-{days(30)}"
LOY30 = f"transaction_at>={NOW_LOY}-{days(30)}"
MEMBER = "CASE WHEN member_id IS NOT NULL THEN 'member' ELSE 'non_member' END"
WEB_ID = "web-100"
SPEND = "SELECT member_id IS NOT NULL m, * FROM guest_order"


def week(c):
    return f"CAST(date_trunc('week',{c}) AS DATE) AS week"


def month(c):
    return f"CAST(date_trunc('month',{c}) AS DATE) AS month"


def of_tender(tender):
    return (f"CAST(sum(CASE WHEN tender_type='{tender}' THEN {fx('amount')} ELSE 0 END) AS BIGINT)/10000"
            f"/nullif({S('amount')},0)")


# ---- orders and service
query("q_cancellation_by_store", f"""SELECT unit_id, {P("order_status='cancelled'")} cancellation_rate, count(*) orders
      FROM guest_order WHERE {ORD_MONTH} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: q.cancellation_by_store(t.guest_order, t.order_clock))
query("q_sos_by_hour", f"""SELECT CAST(hour(placed_at) AS INTEGER) hour_of_day, {P('sos_breach')} sos_breach_rate, count(*) orders
      FROM guest_order WHERE placed_at>={NOW_ORD}-{days(14)} GROUP BY 1""")(
    lambda t: q.sos_by_hour(t.guest_order, t.order_clock))
query("q_delivery_gap", f"SELECT avg({GAP}) avg_gap_seconds FROM delivery_order d WHERE {DEL30}")(
    lambda t: q.delivery_gap(t.delivery_order, t.delivery_clock))
query("q_franchisee_revenue_month", f"""SELECT franchisee_name, {S('total_amount')} revenue FROM guest_order
      JOIN franchisee USING (franchisee_id) WHERE {ORD_MONTH} GROUP BY 1""")(
    lambda t: q.franchisee_revenue_month(t.guest_order, t.franchisee, t.order_clock))
query("q_channel_revenue", f"""SELECT channel, count(*) orders, {S('total_amount')} revenue, {A('total_amount')} aov
      FROM guest_order WHERE {ORD30} GROUP BY 1""")(lambda t: q.channel_revenue(t.guest_order, t.order_clock))
query("qv_sos_by_channel", f"""SELECT channel, {P('sos_breach')} sos_breach_rate, count(*) orders FROM guest_order
      WHERE placed_at>={NOW_ORD}-{days(14)} GROUP BY 1""")(lambda t: q.sos_by_channel(t.guest_order, t.order_clock))
query("qv_gap_by_store", f"""SELECT unit_id, avg({GAP}) avg_gap_seconds, avg(actual_delivery_seconds) avg_actual_seconds,
      count(*) deliveries FROM delivery_order d WHERE {DEL30} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: q.gap_by_store(t.delivery_order, t.delivery_clock))
query("qv_revenue_by_type", f"""SELECT order_type, {S('total_amount')} revenue, count(*) orders,
      {C("order_status='cancelled'")} cancelled, {C("order_status='fulfilled'")} fulfilled FROM guest_order
      WHERE {ORD30} GROUP BY 1""")(lambda t: q.revenue_by_type(t.guest_order, t.order_clock))

# ---- loyalty
query("q_member_share_by_store", f"""SELECT unit_id, {P('member_id IS NOT NULL')} member_order_share, count(*) orders
      FROM guest_order WHERE {ORD30} GROUP BY 1""")(lambda t: q.member_share_by_store(t.guest_order, t.order_clock))
query("q_breakage_by_tier", f"""SELECT tier, 1-({I(BURN)}/nullif({I(EARN)},0)) breakage_rate FROM loyalty_transaction
      WHERE {LOY30} GROUP BY 1""")(lambda t: q.breakage_by_tier(t.loyalty_transaction, t.loyalty_clock))
query("qv_redemption_by_tier", f"""SELECT tier, {I(BURN)}/nullif({I(EARN)},0) redemption_rate FROM loyalty_transaction
      WHERE {LOY30} GROUP BY 1""")(lambda t: q.redemption_by_tier(t.loyalty_transaction, t.loyalty_clock))
query("q_active_members_weekly", f"""SELECT {week('transaction_at')}, count(DISTINCT member_id) active_members
      FROM loyalty_transaction WHERE transaction_at>={NOW_LOY}-{days(90)} GROUP BY 1""", ("week",))(
    lambda t: q.active_members_weekly(t.loyalty_transaction, t.loyalty_clock))
query("q_redemptions_week", f"""SELECT count(*) redemptions, {S('reward_value')} total_reward_value FROM reward_redemption
      WHERE redeemed_at>=CAST({NOW_LOY} AS DATE)-7""")(lambda t: q.redemptions_week(t.reward_redemption, t.loyalty_clock))
query("q_active_digital_accounts", """SELECT count(*) active_digital_accounts FROM digital_account
      WHERE account_status='active'""")(lambda t: q.active_digital_accounts(t.digital_account))
query("qv_engagement_franchisee", f"""SELECT franchisee_id, count(DISTINCT member_id) members, count(*) transactions
      FROM loyalty_transaction WHERE transaction_at>=date_trunc('month',{NOW_LOY}) GROUP BY 1""")(
    lambda t: q.engagement_by_franchisee(t.loyalty_transaction, t.loyalty_clock))
query("qv_earn_redeem_counts", f"""SELECT transaction_type, count(*) transactions FROM loyalty_transaction WHERE {LOY30}
      GROUP BY 1""")(lambda t: q.earn_redeem_counts(t.loyalty_transaction, t.loyalty_clock))

# ---- inventory
query("q_overproduction_share", f"""SELECT CAST(sum(CASE WHEN waste_category='overproduction' THEN {fx('waste_cost')} ELSE 0 END)
      AS BIGINT)/10000/nullif({S('waste_cost')},0) overproduction_share FROM waste_log WHERE {WST30}""")(
    lambda t: q.overproduction_share(t.waste_log, t.waste_clock))
RCV30 = f"created_at>={NOW_RCV}-{days(30)}"
query("q_receiving_failure", f"""SELECT {P("quality_inspection_result<>'pass'")} quality_failure_rate, count(*) receipts
      FROM receiving_order WHERE {RCV30}""")(lambda t: q.receiving_failure(t.receiving_order, t.ship_clock))
query("q_cold_chain", f"""SELECT {P('temperature_check_pass')} cold_chain_compliance_rate FROM receiving_order
      WHERE {RCV30}""")(lambda t: q.cold_chain(t.receiving_order, t.ship_clock))
query("q_open_pos", "SELECT count(*) open_pos FROM replenishment_order WHERE order_status='open'")(
    lambda t: q.open_pos(t.replenishment_order))
query("q_bom_cost", f"""SELECT item_name, {S('quantity*cost_per_unit')} extended_ingredient_cost FROM recipe_ingredient
      JOIN menu_item USING (menu_item_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: q.bom_cost(t.recipe_ingredient, t.menu_item))
query("qv_overproduction_weekly", f"""SELECT {week('logged_at')}, {S('waste_cost')} waste_cost, count(*) events FROM waste_log
      WHERE waste_category='overproduction' GROUP BY 1""", ("week",))(lambda t: q.overproduction_weekly(t.waste_log))
query("qv_overproduction_by_store", f"""SELECT unit_id, {S('waste_cost')} waste_cost FROM waste_log WHERE {WST30}
      AND waste_category='overproduction' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: q.overproduction_by_store(t.waste_log, t.waste_clock))
query("qv_waste_per_event", f"""SELECT unit_id, {S('waste_cost')}/count(*) cost_per_event, count(*) events FROM waste_log
      WHERE {WST30} GROUP BY 1""")(lambda t: q.waste_per_event(t.waste_log, t.waste_clock))
query("qv_waste_by_daypart", f"""SELECT CASE WHEN hour(logged_at)<10 THEN 'morning' WHEN hour(logged_at)<=14 THEN 'lunch'
      WHEN hour(logged_at)<=16 THEN 'afternoon' WHEN hour(logged_at)<=21 THEN 'dinner' ELSE 'late_night' END daypart,
      {S('waste_cost')} waste_cost, count(*) events FROM waste_log GROUP BY 1""")(lambda t: q.waste_by_daypart(t.waste_log))
query("q_most_below_par", f"""SELECT unit_id, count(*) skus_below_par, {S('shortfall')} shortfall FROM below_par GROUP BY 1""")(
    lambda t: q.most_below_par(t.on_hand_balance))

# ---- workforce
WEEK_EVT = f"punch_in>=CAST({NOW_EVT} AS DATE)-7"
query("q_labor_hours_week", f"SELECT unit_id, {S('hours_worked')} labor_hours FROM time_punch WHERE {WEEK_EVT} GROUP BY 1")(
    lambda t: q.labor_hours_week(t.time_punch, t.event_clock))
query("q_headcount_store", f"""SELECT count(DISTINCT employee_id) employees FROM time_punch WHERE unit_id=13
      AND punch_in>=date_trunc('month',{NOW_EVT})""")(lambda t: q.headcount_store(t.time_punch, 13, t.event_clock))
query("q_shift_status", f"""SELECT status, count(*) shifts FROM shift WHERE CAST(date AS DATE)>=CAST({NOW_EVT} AS DATE)-7
      GROUP BY 1""")(lambda t: q.shift_status(t.shift, t.event_clock))
query("qv_shift_completion", f"""SELECT {P("status='completed'")} completion_rate, count(*) shifts FROM shift
      WHERE CAST(date AS DATE)>=CAST({NOW_EVT} AS DATE)-7""")(lambda t: q.shift_completion(t.shift, t.event_clock))
query("q_headcount_franchisee", f"""SELECT franchisee_id, count(DISTINCT employee_id) headcount FROM time_punch
      WHERE punch_in>=date_trunc('month',{NOW_EVT}) GROUP BY 1""")(
    lambda t: q.headcount_franchisee(t.time_punch, t.event_clock))
LPO = f"""(SELECT unit_id, h/nullif(n,0) labor_hours_per_order FROM (SELECT unit_id, {S('hours_worked')} h FROM time_punch
      WHERE punch_in>=CAST({NOW_EVT} AS DATE)-30 GROUP BY 1) JOIN (SELECT unit_id, count(*) n FROM guest_order
      WHERE placed_at>=CAST({NOW_ORD} AS DATE)-30 GROUP BY 1) USING (unit_id))"""
query("q_labor_per_order", f"SELECT * FROM {LPO} ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda t: q.top(q.labor_per_order(t.time_punch, t.guest_order, t.event_clock, t.order_clock, 30), 20,
                    "labor_hours_per_order", "unit_id"))
OVER = f"""(SELECT employee_id, max(unit_id) unit_id, {S('hours_worked')} AS hours FROM time_punch
      WHERE punch_in>={NOW_EVT}-{days(7)} GROUP BY 1 HAVING {S('hours_worked')}>40)"""
query("qv_overtime_by_store", f"SELECT unit_id, {S('hours-40')} overtime_hours, count(*) employees FROM {OVER} GROUP BY 1")(
    lambda t: q.overtime_by_store(t.time_punch, t.event_clock))
query("qv_hours_per_shift", f"""SELECT unit_id, {A('hours_worked')} avg_hours, count(*) punches FROM time_punch
      WHERE punch_in>={NOW_EVT}-{days(7)} GROUP BY 1""")(lambda t: q.hours_per_shift(t.time_punch, t.event_clock))
query("qv_top_employees", f"""SELECT employee_id, {S('hours_worked')} AS hours FROM time_punch
      WHERE punch_in>={NOW_EVT}-{days(7)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: q.top_employees(t.time_punch, t.event_clock))


# ---- demand risk
def outlook(t, n=7):
    return tables.demand_risk(t.demand_risk_forecast, t.today, n)


query("q_risk_units", """SELECT unit_id, metro_area, avg_demand_multiplier, demand_risk_days, capacity_risk_days
      FROM risk_outlook ORDER BY demand_risk_days DESC, avg_demand_multiplier, unit_id LIMIT 20""")(
    lambda t: q.risk_units(outlook(t)))
query("q_capacity_units", f"""SELECT unit_id, max(metro_area) metro_area, {C("risk_level='capacity_risk'")} capacity_risk_days,
      {A('combined_demand_multiplier')} avg_demand_multiplier FROM demand_risk_forecast GROUP BY 1
      HAVING {C("risk_level='capacity_risk'")}>0""")(lambda t: q.capacity_units(outlook(t, 14)))
NEXT14 = f"BETWEEN {TODAY} AND {TODAY}+14"
NEXT7 = f"BETWEEN {TODAY} AND {TODAY}+7"
query("q_top_events", f"""SELECT event_name, metro_area, event_date, event_category, est_attendance, est_demand_multiplier, event_id
      FROM local_events WHERE event_date {NEXT14} ORDER BY est_demand_multiplier DESC, event_id LIMIT 20""", ("event_date",))(
    lambda t: q.top_events(t.local_events, t.today))
query("qv_events_attendance", f"""SELECT event_name, metro_area, event_date, est_attendance, event_id FROM local_events
      WHERE event_date {NEXT14} ORDER BY est_attendance DESC, event_id LIMIT 20""", ("event_date",))(
    lambda t: q.events_by_attendance(t.local_events, t.today))
query("q_weather_effect", f"""SELECT weather_condition, {A('demand_multiplier')} avg_multiplier, count(*) AS days
      FROM weather_conditions WHERE forecast_date>={TODAY} GROUP BY 1""")(lambda t: q.weather_effect(t.weather_conditions, t.today))
query("q_metro_risk_days", f"""SELECT metro_area, {C("risk_level='demand_risk'")} demand_risk_days FROM demand_risk_forecast
      GROUP BY 1""")(lambda t: q.metro_risk_days(t.demand_risk_forecast, t.today))
query("qv_metro_risk_split", f"""SELECT metro_area, {C("risk_level='demand_risk'")} demand_risk_days,
      {C("risk_level='capacity_risk'")} capacity_risk_days FROM demand_risk_forecast WHERE forecast_date {NEXT7} GROUP BY 1""")(
    lambda t: q.metro_risk_split(t.demand_risk_forecast, t.today))
query("qv_store_forecast", f"""SELECT forecast_date, weather_condition, alert_level, event_name, combined_demand_multiplier,
      risk_level FROM demand_risk_forecast WHERE unit_id=13 AND forecast_date {NEXT7}""", ("forecast_date",))(
    lambda t: q.store_forecast(t.demand_risk_forecast, 13, t.today))
query("qv_metro_daily_multiplier", f"""SELECT forecast_date, {A('combined_demand_multiplier')} avg_multiplier
      FROM demand_risk_forecast WHERE metro_area='ASIA' GROUP BY 1""", ("forecast_date",))(
    lambda t: q.metro_daily_multiplier(t.demand_risk_forecast, "ASIA", t.today))
query("qv_weather_alerts", """SELECT DISTINCT unit_id, metro_area, forecast_date, alert_level FROM demand_risk_forecast
      WHERE alert_level IS NOT NULL""", ("forecast_date",))(lambda t: q.weather_alerts(t.demand_risk_forecast, t.today))

# ---- franchisees
query("q_scorecard", "SELECT * FROM scorecard ORDER BY revenue DESC, franchisee_id LIMIT 20")(
    lambda t: q.top(scorecard(t), 20, "revenue", "franchisee_id"))
query("q_scorecard_waste", """SELECT franchisee_id, waste_cost FROM scorecard ORDER BY waste_cost DESC NULLS LAST,
      franchisee_id LIMIT 10""")(
    lambda t: q.top(scorecard(t).select("franchisee_id", "waste_cost"), 10, "waste_cost", "franchisee_id"))
query("q_scorecard_sos", """SELECT franchisee_id, sos_breach_rate, orders FROM scorecard ORDER BY sos_breach_rate DESC,
      franchisee_id LIMIT 10""")(
    lambda t: q.top(scorecard(t).select("franchisee_id", "sos_breach_rate", "orders"), 10, "sos_breach_rate", "franchisee_id"))
query("q_franchisee_stores", f"""SELECT franchisee_id, count(DISTINCT unit_id) stores, {S('total_amount')} revenue
      FROM guest_order WHERE {ORD_MONTH} GROUP BY 1""")(lambda t: q.franchisee_stores(t.guest_order, t.unit, t.order_clock))
query("q_region_revenue", f"SELECT region_id, {S('total_amount')} revenue FROM guest_order WHERE {ORD_MONTH} GROUP BY 1")(
    lambda t: q.region_revenue(t.guest_order, t.unit, t.order_clock))
query("qv_franchisee_aov", f"""SELECT franchisee_id, {A('total_amount')} avg_order_value, count(*) orders FROM guest_order
      WHERE {ORD30} GROUP BY 1""")(lambda t: q.franchisee_aov(t.guest_order, t.unit, t.order_clock))
query("qv_franchisee_monthly", f"""SELECT {month('placed_at')}, {S('total_amount')} revenue, count(*) orders FROM guest_order
      WHERE franchisee_id=3 GROUP BY 1""", ("month",))(lambda t: q.franchisee_monthly(t.guest_order, 3))
query("qv_franchisee_labor", """SELECT franchisee_id, labor_hours/nullif(revenue,0) labor_per_revenue,
      revenue/nullif(labor_hours,0) revenue_per_labor_hour FROM scorecard""")(lambda t: q.franchisee_labor(scorecard(t)))
query("q_top_bottom5", """SELECT * FROM (SELECT franchisee_id, revenue,
      CAST(row_number() OVER (ORDER BY revenue DESC, franchisee_id NULLS FIRST) AS INTEGER) from_top,
      CAST(row_number() OVER (ORDER BY revenue, franchisee_id NULLS FIRST) AS INTEGER) from_bottom FROM scorecard)
      WHERE from_top<=5 OR from_bottom<=5""")(lambda t: q.top_bottom(scorecard(t)))
query("q_underperformers", """SELECT * FROM (SELECT franchisee_id, revenue, sos_breach_rate,
      percent_rank() OVER (ORDER BY revenue) revenue_rank, percent_rank() OVER (ORDER BY sos_breach_rate DESC) sos_rank
      FROM scorecard) WHERE revenue_rank<=0.5 AND sos_rank<=0.5""")(lambda t: q.underperformers(scorecard(t)))

# ---- delivery
D_ORDER = "delivery_order d JOIN guest_order g USING (guest_order_id)"
query("q_gap_by_metro", f"""SELECT metro_area, avg({GAP}) avg_gap_seconds FROM {D_ORDER} JOIN unit u ON u.unit_id=g.unit_id
      WHERE {DEL30} GROUP BY 1""")(lambda t: q.gap_by_metro(t.delivery_order, t.unit, t.delivery_clock))
query("q_late_by_channel", f"""SELECT channel, {P(LATE)} late_rate, count(*) deliveries FROM {D_ORDER} WHERE {DEL30}
      AND channel IN ('own_delivery','3pd_delivery') GROUP BY 1""")(
    lambda t: q.late_by_channel(t.delivery_order, t.guest_order, t.delivery_clock))
query("q_volume_by_channel", f"SELECT channel, count(*) deliveries FROM {D_ORDER} WHERE {DEL30} GROUP BY 1")(
    lambda t: q.volume_by_channel(t.delivery_order, t.guest_order, t.delivery_clock))
query("q_volume_by_metro", f"""SELECT metro_area, count(*) deliveries FROM {D_ORDER} JOIN unit u ON u.unit_id=g.unit_id
      WHERE {DEL30} GROUP BY 1""")(lambda t: q.volume_by_metro(t.delivery_order, t.unit, t.delivery_clock))
query("q_late_vs_ontime", f"""SELECT CASE WHEN {LATE} THEN 'late' ELSE 'on_time' END status, count(*) deliveries
      FROM delivery_order WHERE created_at>={NOW_DEL}-{days(14)} GROUP BY 1""")(
    lambda t: q.late_vs_ontime(t.delivery_order, t.delivery_clock))
query("q_wow_late_rate", f"""SELECT * FROM (SELECT *, lag(late_rate) OVER (PARTITION BY unit_id ORDER BY week) previous_rate
      FROM (SELECT unit_id, {week('created_at')}, {P(LATE)} late_rate FROM delivery_order GROUP BY 1,2))
      WHERE late_rate<previous_rate""", ("week",))(lambda t: q.wow_late_rate(t.delivery_order))
query("q_delivery_share", f"""SELECT order_type, count(*) orders, count(*)/CAST(sum(count(*)) OVER () AS BIGINT) share
      FROM guest_order WHERE {ORD30} GROUP BY 1""")(lambda t: q.delivery_share(t.guest_order, t.order_clock))

# ---- menu
MARGIN = f"(({fx('base_price')}-{fx('cost')})/10000)"
query("q_gross_margin", f"""SELECT menu_item_id, item_name, category, base_price, cost, {MARGIN} gross_margin,
      {MARGIN}/nullif(base_price,0) margin_pct FROM menu_item ORDER BY {MARGIN} DESC, menu_item_id LIMIT 20""")(
    lambda t: q.gross_margin(t.menu_item))
query("qv_low_margin", f"""SELECT menu_item_id, item_name, {MARGIN} gross_margin FROM menu_item
      ORDER BY {MARGIN}, menu_item_id LIMIT 20""")(lambda t: q.low_margin(t.menu_item))
query("qv_category_prices", f"""SELECT category, {A('base_price')} avg_price, {A('cost')} avg_cost FROM menu_item GROUP BY 1""")(
    lambda t: q.category_prices(t.menu_item))
ITEMS30 = f"order_item JOIN menu_item USING (menu_item_id) WHERE placed_at>={NOW_ORD}-{days(30)}"
query("q_category_revenue", f"""SELECT category, {I('quantity')} units_sold, {S('line_net_amount')} revenue
      FROM {ITEMS30} GROUP BY 1""")(lambda t: q.menu_group(t.order_item, t.menu_item, "category", t.order_clock))
query("q_daypart_mix", f"""SELECT daypart, {I('quantity')} units_sold, {S('line_net_amount')} revenue
      FROM {ITEMS30} GROUP BY 1""")(lambda t: q.menu_group(t.order_item, t.menu_item, "daypart", t.order_clock))
query("qv_category_share", f"""SELECT category, r/10000 revenue, r/CAST(sum(r) OVER () AS BIGINT) share FROM (SELECT category,
      {I(fx('line_net_amount'))} r FROM {ITEMS30} GROUP BY 1)""")(
    lambda t: q.category_share(t.order_item, t.menu_item, t.order_clock))
query("q_top_items_units", f"""SELECT menu_item_id, item_name, {I('quantity')} units_sold, {S('line_net_amount')} revenue
      FROM {ITEMS30} GROUP BY 1,2 ORDER BY 3 DESC, 1 LIMIT 10""")(
    lambda t: q.top_items_units(t.order_item, t.menu_item, t.order_clock))
query("qv_top_items_revenue", f"""SELECT menu_item_id, item_name, {I('quantity')} units_sold, {S('line_net_amount')} revenue
      FROM {ITEMS30} GROUP BY 1,2 ORDER BY 4 DESC, 1 LIMIT 10""")(
    lambda t: q.top_items_units(t.order_item, t.menu_item, t.order_clock, by="revenue"))
query("q_price_drift", f"""SELECT period_name, {A('price_multiplier')} avg_price_multiplier FROM item_price
      JOIN financial_period USING (financial_period_id) GROUP BY period_name, start_date""")(
    lambda t: q.price_drift_trend(t.item_price, t.financial_period))
query("qv_item_price_trend", """SELECT period_name, start_date, price_multiplier FROM item_price
      JOIN financial_period USING (financial_period_id) WHERE menu_item_id=17""")(
    lambda t: q.item_price_trend(t.item_price, t.financial_period, 17))
query("q_channel_availability", """SELECT menu_item_id, item_name, category FROM menu_item WHERE is_3pd_available
      AND NOT is_carryout_available""")(lambda t: q.channel_availability(t.menu_item))

# ---- payments
P_ORDER = "payment p JOIN guest_order g USING (guest_order_id)"
query("q_tender_by_channel", f"""SELECT channel, tender_type, {S('amount')} amount, count(*) payments FROM {P_ORDER}
      WHERE {PAY30} GROUP BY 1,2""")(lambda t: q.tender_by_channel(t.payment, t.guest_order, t.paid_clock))
query("q_wallet_weekly", f"""SELECT {week('paid_at')}, {of_tender('digital_wallet')} digital_wallet_share FROM payment
      WHERE paid_at>={NOW_PAY}-{days(90)} GROUP BY 1""", ("week",))(lambda t: q.wallet_weekly(t.payment, t.paid_clock))
query("q_wallet_by_store", f"""SELECT unit_id, {of_tender('digital_wallet')} digital_wallet_share FROM payment WHERE {PAY30}
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(lambda t: q.wallet_by_store(t.payment, t.paid_clock))
query("q_avg_payment", f"""SELECT tender_type, {A('amount')} avg_amount, count(*) payments FROM payment WHERE {PAY30}
      GROUP BY 1""")(lambda t: q.avg_payment(t.payment, t.paid_clock))
query("q_tender_by_segment", f"""SELECT {MEMBER} segment, tender_type, {S('amount')} amount FROM {P_ORDER} WHERE {PAY30}
      GROUP BY 1,2""")(lambda t: q.tender_by_segment(t.payment, t.guest_order, t.paid_clock))
query("q_payments_month", f"""SELECT tender_type, count(*) payments FROM payment
      WHERE paid_at>=date_trunc('month',{NOW_PAY}) GROUP BY 1""")(lambda t: q.payments_month(t.payment, t.paid_clock))
query("qv_tender_share", f"""SELECT {of_tender('digital_wallet')} wallet_share, {of_tender('loyalty_redemption')} redemption_share
      FROM payment WHERE {PAY30}""")(lambda t: q.tender_share(t.payment, t.paid_clock))
query("qv_settled_by_tender", f"SELECT tender_type, {S('amount')} settled FROM payment GROUP BY 1")(
    lambda t: q.settled_by_tender(t.payment))
query("qv_cash_metro", f"""SELECT metro_area, {S('amount')} cash_amount FROM payment JOIN unit USING (unit_id) WHERE {PAY30}
      AND tender_type='cash' GROUP BY 1""")(lambda t: q.cash_by_metro(t.payment, t.unit, t.paid_clock))
query("qv_cash_monthly", f"SELECT {month('paid_at')}, {of_tender('cash')} cash_share FROM payment GROUP BY 1", ("month",))(
    lambda t: q.cash_monthly(t.payment))

# ---- guests
query("q_profiles_by_status", "SELECT account_status, count(*) profiles FROM guest_profile GROUP BY 1")(
    lambda t: q.profiles_by_status(t.guest_profile))
query("q_digital_adoption", """SELECT gp.unit_id, count(DISTINCT da.guest_profile_id)/nullif(count(DISTINCT gp.guest_profile_id),0)
      digital_adoption_rate FROM guest_profile gp LEFT JOIN digital_account da ON da.guest_profile_id=gp.guest_profile_id
      AND da.account_status='active' GROUP BY 1""")(lambda t: q.digital_adoption(t.guest_profile, t.digital_account))
query("q_new_profiles_month", f"""SELECT count(*) new_profiles FROM guest_profile
      WHERE created_at>=date_trunc('month',{NOW_EVT})""")(lambda t: q.new_profiles_month(t.guest_profile, t.event_clock))
query("q_registrations_weekly", f"""SELECT {week('created_at')}, count(*) new_profiles FROM guest_profile
      WHERE created_at>={NOW_EVT}-{days(90)} GROUP BY 1""", ("week",))(
    lambda t: q.registrations_weekly(t.guest_profile, t.event_clock))
query("q_suspended_by_metro", """SELECT metro_area, count(*) suspended FROM guest_profile JOIN unit USING (unit_id)
      WHERE account_status='suspended' GROUP BY 1""")(lambda t: q.suspended_by_metro(t.guest_profile, t.unit))
query("q_active_digital_by_store", """SELECT unit_id, count(*) active_digital_accounts FROM guest_profile JOIN digital_account da
      USING (guest_profile_id) WHERE da.account_status='active' GROUP BY 1""")(
    lambda t: q.active_digital_by_store(t.guest_profile, t.digital_account))
query("qv_active_share_franchisee", f"""SELECT franchisee_id, {P("account_status='active'")} active_share, count(*) profiles
      FROM guest_profile GROUP BY 1""")(lambda t: q.active_share_franchisee(t.guest_profile))
query("qv_new_guests_by_store", f"""SELECT unit_id, count(*) new_profiles FROM guest_profile
      WHERE created_at>={NOW_EVT}-{days(30)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda t: q.new_guests_by_store(t.guest_profile, t.event_clock))
query("qv_digital_ratio", """SELECT unit_id, CAST(sum(coalesce(n,0)) AS BIGINT)/count(*) accounts_per_profile FROM guest_profile
      LEFT JOIN (SELECT guest_profile_id, count(*) n FROM digital_account GROUP BY 1) USING (guest_profile_id) GROUP BY 1""")(
    lambda t: q.digital_ratio(t.guest_profile, t.digital_account))
query("q_guests_without_orders", """SELECT account_status, count(*) guests FROM guest_profile gp WHERE NOT EXISTS
      (FROM guest_order g WHERE g.profile_id=gp.guest_profile_id) GROUP BY 1""")(
    lambda t: q.guests_without_orders(t.guest_profile, t.guest_order))

# ---- customers
query("q_churn_risk", """SELECT profile_id, recency_days, total_orders, monetary_total, tier FROM customer_features
      WHERE recency_days>=0 ORDER BY recency_days DESC, profile_id LIMIT 50""")(lambda t: q.churn_risk(t.customer_features))
query("q_value_by_tier", f"""SELECT tier, {A('monetary_total')} avg_lifetime_spend, {A('aov')} avg_aov, count(*) customers
      FROM customer_features GROUP BY 1""")(lambda t: q.value_by_tier(t.customer_features))
query("q_never_ordered", "SELECT count(*) never_ordered FROM customer_features WHERE recency_days=-1")(
    lambda t: q.never_ordered(t.customer_features))


def avg6(c):
    return f"CAST(sum({fx(c, 1000000)}) AS BIGINT)/1000000/count({c})"


query("q_affinity_by_tier", f"SELECT tier, {avg6('affinity_pizza')} avg_pizza_affinity FROM customer_features GROUP BY 1")(
    lambda t: q.affinity_by_tier(t.customer_features))
query("q_top_customers", """SELECT profile_id, monetary_total, total_orders, aov, tier FROM customer_features
      ORDER BY monetary_total DESC, profile_id LIMIT 20""")(lambda t: q.top_customers(t.customer_features))
query("q_tier_distribution", "SELECT tier, count(*) customers FROM customer_features GROUP BY 1")(
    lambda t: q.tier_distribution(t.customer_features))
query("qv_order_frequency", """SELECT profile_id, total_orders, monetary_total FROM customer_features
      ORDER BY total_orders DESC, profile_id LIMIT 20""")(lambda t: q.frequent_customers(t.customer_features))
query("qv_recency_by_tier", """SELECT tier, avg(CASE WHEN recency_days>=0 THEN recency_days END) avg_recency_days
      FROM customer_features GROUP BY 1""")(lambda t: q.recency_by_tier(t.customer_features))
query("qv_mean_affinities", "SELECT " + ", ".join(f"{avg6('affinity_' + c)} avg_{c}" for c in CATEGORIES)
      + " FROM customer_features")(lambda t: q.mean_affinities(t.customer_features, CATEGORIES))
query("qv_store_aov", "SELECT * FROM store_aov ORDER BY store_aov DESC, unit_id LIMIT 20")(
    lambda t: q.stores_by_aov(t.store_features))
query("q_top_decile_customers", f"""SELECT count(*) FILTER (WHERE h) customers, count(*) FILTER (WHERE h)/count(*) customer_share,
      CAST(sum(CASE WHEN h THEN v ELSE 0 END) AS BIGINT)/CAST(sum(v) AS BIGINT) spend_share FROM (SELECT
      (rank() OVER (ORDER BY v DESC)-1)*10<count(*) OVER () h, v FROM (SELECT {fx('monetary_total')} v FROM customer_features))""")(
    lambda t: q.top_decile_customers(t.customer_features))

# ---- cross-domain
PER_STORE = f"""(SELECT unit_id, {P('member_id IS NOT NULL')} member_share, {A('total_amount')} aov FROM guest_order
      WHERE placed_at>={NOW_ORD}-{days(90)} GROUP BY 1)"""
query("q_member_aov_corr", f"SELECT round(corr(member_share,aov),6) correlation, count(*) stores FROM {PER_STORE}")(
    lambda t: q.member_aov_corr(q.member_aov_by_store(t.guest_order, t.order_clock)))
query("q_member_share_quintiles", f"""SELECT CAST(quintile AS INTEGER) quintile, count(*) stores, {R('avg(aov)', 4)} avg_aov FROM
      (SELECT *, ntile(5) OVER (ORDER BY member_share, unit_id) quintile FROM {PER_STORE}) GROUP BY 1""")(
    lambda t: q.member_share_quintiles(q.member_aov_by_store(t.guest_order, t.order_clock)))
query("q_labor_quartile_sos", f"""SELECT CAST(quartile AS INTEGER) quartile, count(*) stores,
      CAST(sum(b) AS BIGINT)/CAST(sum(n) AS BIGINT) sos_breach_rate FROM
      (SELECT *, ntile(4) OVER (ORDER BY labor_hours_per_order, unit_id) quartile FROM {LPO}) JOIN
      (SELECT unit_id, {C('sos_breach')} b, count(*) n FROM guest_order WHERE placed_at>=CAST({NOW_ORD} AS DATE)-30 GROUP BY 1)
      USING (unit_id) GROUP BY 1""")(
    lambda t: q.labor_quartile_sos(t.time_punch, t.guest_order, t.event_clock, t.order_clock))
query("q_daily_trend", f"""SELECT * FROM
      (SELECT CAST(placed_at AS DATE) date, {S('total_amount')} revenue FROM guest_order WHERE unit_id=13 GROUP BY 1)
      FULL JOIN (SELECT CAST(created_at AS DATE) date, {P(LATE)} late_rate FROM delivery_order WHERE unit_id=13 GROUP BY 1)
      USING (date) FULL JOIN (SELECT CAST(punch_in AS DATE) date, {S('hours_worked')} labor_hours FROM time_punch
      WHERE unit_id=13 GROUP BY 1) USING (date) FULL JOIN (SELECT CAST(logged_at AS DATE) date, {S('waste_cost')} waste_cost
      FROM waste_log WHERE unit_id=13 GROUP BY 1) USING (date)""", ("date",))(
    lambda t: q.daily_trend(t.guest_order, t.delivery_order, t.time_punch, t.waste_log, 13))
query("qv_belowpar_vs_waste", f"""SELECT unit_id, coalesce(n,0) skus_below_par, waste_cost FROM (SELECT unit_id,
      {S('waste_cost')} waste_cost FROM waste_log GROUP BY 1) LEFT JOIN (SELECT unit_id, count(*) n FROM below_par GROUP BY 1)
      USING (unit_id)""")(lambda t: q.belowpar_vs_waste(t.on_hand_balance, t.waste_log))
SOS30 = f"(SELECT unit_id, {P('sos_breach')} sos_breach_rate FROM guest_order WHERE {ORD30} GROUP BY 1)"
query("qv_productivity_vs_breach", f"""SELECT unit_id, r/nullif(h,0) sales_per_labor_hour, sos_breach_rate FROM
      (SELECT unit_id, {S('hours_worked')} h FROM time_punch WHERE punch_in>={NOW_EVT}-{days(30)} GROUP BY 1) JOIN
      (SELECT unit_id, {S('daily_revenue')} r FROM unit_performance_daily WHERE date>=CAST({NOW_ORD} AS DATE)-30 GROUP BY 1)
      USING (unit_id) JOIN {SOS30} USING (unit_id)""")(
    lambda t: q.productivity_vs_breach(
        tables.sales_per_labor_hour(t.time_punch, gold.unit_performance_daily(t.guest_order), 30, t.event_clock, t.order_clock),
        tables.sos_compliance(t.guest_order, 30, t.order_clock)))
query("qv_overtime_vs_breach", f"""SELECT unit_id, sos_breach_rate, coalesce(o,0::DOUBLE) overtime_hours FROM {SOS30}
      LEFT JOIN (SELECT unit_id, {S('hours-40')} o FROM {OVER} GROUP BY 1) USING (unit_id)""")(
    lambda t: q.overtime_vs_breach(q.overtime_by_store(t.time_punch, t.event_clock),
                                   tables.sos_compliance(t.guest_order, 30, t.order_clock)))

# ---- web orders
query("order_reconciliation", "SELECT * FROM reconciled", ("web_order_ts", "silver_placed_at"))(lambda t: recon(t))
query("web_order_live", "SELECT * FROM live_header", ("web_order_ts",))(lambda t: live(t))
query("web_order_item_live", "SELECT * FROM live_item")(lambda t: live_items(t))
query("demand_risk_forecast", "SELECT * FROM demand_risk_forecast", ("forecast_date",))(lambda t: t.demand_risk_forecast)
query("demand_risk_one_row_per_day", """SELECT unit_id, forecast_date, event_name, combined_demand_multiplier, risk_level
      FROM demand_risk_forecast QUALIFY row_number() OVER (PARTITION BY unit_id, forecast_date
      ORDER BY event_demand_multiplier DESC NULLS LAST, event_name DESC)=1""", ("forecast_date",))(lambda t: one_row(t))
query("q_reconciled_split", f"""SELECT reconciled, count(*) orders, {R(S('web_amount'), 2)} web_revenue
      FROM reconciled GROUP BY 1""")(lambda t: q.reconciled_split(recon(t)))
query("q_reconcile_one", f"""SELECT web_order_id, guest_order_id, reconciled, web_amount, silver_total_amount, amount_diff
      FROM reconciled WHERE web_order_id='{WEB_ID}'""")(lambda t: q.reconcile_one(recon(t), WEB_ID))
query("q_matched_split", "SELECT customer_matched, count(*) orders FROM reconciled GROUP BY 1")(
    lambda t: q.matched_split(recon(t)))
DETAIL = """SELECT h.web_order_id, web_store_id, web_store_city, web_store_state, web_store_zip, channel, order_stage, web_amount,
      web_item_count, web_total_quantity, web_order_ts, menu_item_id, item_name, category, quantity, unit_price, line_amount,
      member_id, customer_matched, customer_tier, customer_total_orders, customer_lifetime_spend
      FROM live_header h LEFT JOIN live_item i USING (web_order_id)"""
query("q_web_order_detail", f"{DETAIL} WHERE h.web_order_id='{WEB_ID}'", ("web_order_ts",))(
    lambda t: q.web_order_detail(live(t), live_items(t), WEB_ID))
query("q_web_order_customer", f"""SELECT web_order_id, member_id, customer_matched, customer_tier, customer_total_orders,
      customer_lifetime_spend, web_store_city, web_store_state, web_amount FROM live_header WHERE web_order_id='{WEB_ID}'""")(
    lambda t: q.web_order_customer(live(t), WEB_ID))


def recon(t):
    from platelake.operators import silver, telemetry, views

    orders = telemetry.events_of(telemetry.order_base(t.otel_logs, t.otel_spans, t.unit), telemetry.order_events())
    landed = silver.guest_order(orders, t.unit, "event_ts")
    return views.order_reconciliation(t.otel_logs, t.otel_spans, landed, t.customer_features)


def live(t):
    from platelake.operators import views

    return views.web_order_live(t.otel_logs, t.otel_spans, t.customer_features)


def live_items(t):
    from platelake.operators import views

    return views.web_order_item_live(t.otel_logs, t.otel_spans, t.menu_item)


def one_row(t):
    from platelake.operators import views

    return views.demand_risk_forecast(t.unit, t.weather_conditions, t.local_events, t.today, one_row_per_day=True).select(
        "unit_id", "forecast_date", "event_name", "combined_demand_multiplier", "risk_level")
