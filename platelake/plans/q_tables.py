"""Silver, gold and table-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from platelake import schemas
from platelake.operators import gold, quality, silver, tables
from platelake.plans.duck import (A, BURN, C, EARN, I, LATE, NOW_DEL, NOW_EVT, NOW_LOY, NOW_ORD, NOW_PAY, NOW_WST, P,
                                  R, S, days)
from platelake.plans.registry import query

STAMP = "event_ts"

# ---- silver: the engine's demultiplexer over the whole envelope

query("silver_guest_order", "SELECT * EXCLUDE (prep) FROM guest_order",
      ("placed_at", "ready_at", "fulfilled_at", "cancelled_at", "created_at"))(
    lambda t: silver.guest_order(t.envelope("order_events"), t.unit, STAMP))
query("silver_order_item", "SELECT * FROM order_item", ("placed_at", "created_at"))(
    lambda t: silver.order_item(t.envelope("order_events"), STAMP))
query("silver_payment", "SELECT * FROM payment", ("paid_at", "created_at"))(
    lambda t: silver.payment(t.envelope("order_events"), STAMP))
query("silver_status_event", "SELECT * FROM status_event", ("event_timestamp", "created_at"))(
    lambda t: silver.status_event(t.envelope("order_events"), STAMP))
query("silver_delivery_order", "SELECT * FROM delivery_order", ("created_at",))(
    lambda t: silver.delivery_order(t.envelope("order_events"), STAMP))
query("silver_on_hand_balance", "SELECT * FROM on_hand_balance", ("snapshot_at", "created_at"))(
    lambda t: silver.on_hand_balance(t.envelope("inventory_events"), STAMP))
query("silver_waste_log", "SELECT * FROM waste_log", ("logged_at", "created_at"))(
    lambda t: silver.waste_log(t.envelope("inventory_events"), t.unit, STAMP))
query("silver_receiving_order", "SELECT * FROM receiving_order", ("created_at",))(
    lambda t: silver.receiving_order(t.envelope("inventory_events"), STAMP))
query("silver_replenishment_order", "SELECT * FROM replenishment_order", ("ordered_at", "created_at"))(
    lambda t: silver.replenishment_order(t.envelope("inventory_events"), STAMP))
query("silver_guest_profile", "SELECT * EXCLUDE (digital_account_id) FROM guest_profile", ("created_at",))(
    lambda t: silver.guest_profile(t.envelope("guest_events"), t.unit))
query("silver_digital_account", "SELECT * FROM digital_account", ("created_at",))(
    lambda t: silver.digital_account(t.envelope("guest_events"), STAMP))
query("silver_digital_account_distinct", """SELECT * FROM digital_account QUALIFY row_number() OVER
      (PARTITION BY digital_account_id ORDER BY created_at DESC)=1""", ("created_at",))(
    lambda t: silver.digital_account(t.envelope("guest_events"), STAMP, distinct_accounts=True))
query("silver_loyalty_transaction", "SELECT * FROM loyalty_transaction", ("transaction_at", "created_at"))(
    lambda t: silver.loyalty_transaction(t.envelope("loyalty_events"), t.unit, STAMP))
query("silver_reward_redemption", "SELECT * FROM reward_redemption", ("redeemed_at", "created_at"))(
    lambda t: silver.reward_redemption(t.envelope("loyalty_events"), STAMP))
query("silver_shift", "SELECT * FROM shift", ("shift_start", "shift_end", "created_at"))(
    lambda t: silver.shift(t.envelope("workforce_events"), STAMP))
query("silver_time_punch", "SELECT * FROM time_punch", ("punch_in", "punch_out", "created_at"))(
    lambda t: silver.time_punch(t.envelope("workforce_events"), t.unit, STAMP))
query("scd1_ignore_nulls", """SELECT guest_profile_id, max_by(account_status, created_at) account_status,
      max_by(email, created_at) FILTER (WHERE email IS NOT NULL) email FROM profile_change GROUP BY 1""")(
    lambda t: silver.guest_profile(t.envelope("guest_events"), t.unit, ignore_nulls=True).select(
        "guest_profile_id", "account_status", "email"))

# ---- expectations and integrity

query("expect_or_drop", """SELECT unnest([{'rule':'valid_total','rows_seen':n,'rows_failed':a},
      {'rule':'has_member','rows_seen':n,'rows_failed':b}], recursive:=true) FROM
      (SELECT count(*) n, count(*) FILTER (WHERE NOT total_amount>=0) a, count(*) FILTER (WHERE member_id IS NULL) b
       FROM guest_order)""")(
    lambda t: quality.failed_counts(t.guest_order, {"valid_total": "total_amount >= 0", "has_member": "member_id >= 0"}))
query("expected_orders", "SELECT unit_id, count(*) orders FROM guest_order WHERE member_id>=0 GROUP BY 1")(
    lambda t: quality.expect_or_drop(t.guest_order, {"has_member": "member_id >= 0"}).groupBy("unit_id").agg(
        tables.rows().alias("orders")))
query("validate_integrity", """SELECT unnest(['total_is_subtotal_plus_tax','net_is_gross_minus_discount',
      'known_order_status','guest_order_key_unique','order_item_key_unique','order_item_has_order',
      'order_item_has_menu_item','payment_has_order']) check_name,
      unnest([0,0,0,(SELECT count(*) FROM (SELECT 1 FROM guest_order GROUP BY guest_order_id HAVING count(*)>1)),
      (SELECT count(*) FROM (SELECT 1 FROM order_item GROUP BY order_item_id HAVING count(*)>1)),
      (SELECT count(*) FROM order_item i WHERE NOT EXISTS (FROM guest_order g WHERE g.guest_order_id=i.guest_order_id)),
      (SELECT count(*) FROM order_item i WHERE NOT EXISTS (FROM menu_item m WHERE m.menu_item_id=i.menu_item_id)),0])
      violations""")(
    lambda t: quality.validate_integrity(t.guest_order, t.order_item, t.payment, t.menu_item))

query("integrity_keys", " UNION ALL ".join(
    [f"SELECT '{n}_key_unique' check_name, count(*) violations FROM (SELECT 1 FROM {n} GROUP BY {k} HAVING count(*)>1)"
     for n, k in schemas.PRIMARY_KEYS.items()] +
    [f"SELECT '{n}_has_{p}', count(*) FROM {n} WHERE {schemas.PRIMARY_KEYS[p]} NOT IN (SELECT {schemas.PRIMARY_KEYS[p]} FROM {p})"
     for n, parents in schemas.PARENTS.items() for p in parents]))(
    lambda t: quality.key_checks({n: getattr(t, n) for n in schemas.PRIMARY_KEYS}, schemas.PRIMARY_KEYS, schemas.PARENTS))

# ---- gold

query("unit_performance_daily", "SELECT * FROM unit_performance_daily", ("date",))(
    lambda t: gold.unit_performance_daily(t.guest_order))
query("sos_compliance_summary", f"""SELECT s.unit_id, channel, CAST(placed_at AS DATE) date, count(*) total_orders,
      {I('CAST(is_sos_breach AS INT)')} sos_breaches, avg(elapsed_seconds_in_prior_state) avg_prep_seconds,
      {R('1.0::DOUBLE-sum(CAST(is_sos_breach AS INT))/count(*)', 4)} sos_compliance_pct
      FROM status_event s JOIN guest_order USING (guest_order_id) WHERE current_state='ready' GROUP BY 1,2,3""", ("date",))(
    lambda t: gold.sos_compliance_summary(t.status_event, t.guest_order))
query("loyalty_cohort_metrics", f"""SELECT unit_id, tier, CAST(transaction_at AS DATE) date,
      count(DISTINCT member_id) active_members, {I('points_delta')} total_points_earned, count(*) transaction_count
      FROM loyalty_transaction GROUP BY 1,2,3""", ("date",))(
    lambda t: gold.loyalty_cohort_metrics(t.loyalty_transaction))
query("inventory_waste_summary", f"""SELECT unit_id, CAST(logged_at AS DATE) date, waste_category,
      {S('waste_cost')} total_waste_cost, {S('waste_quantity')} total_waste_qty, count(*) waste_event_count
      FROM waste_log GROUP BY 1,2,3""", ("date",))(
    lambda t: gold.inventory_waste_summary(t.waste_log))

# ---- table functions

query("f_sos_compliance", f"""SELECT unit_id, count(*) total_orders, {C('sos_breach')} sos_breaches,
      {P('sos_breach')} sos_breach_rate FROM guest_order WHERE placed_at>={NOW_ORD}-{days(7)} GROUP BY 1""")(
    lambda t: tables.sos_compliance(t.guest_order, 7, t.order_clock))
query("f_sos_compliance_worst", f"""SELECT unit_id, count(*) total_orders, {C('sos_breach')} sos_breaches,
      {P('sos_breach')} sos_breach_rate FROM guest_order WHERE placed_at>={NOW_ORD}-{days(14)} GROUP BY 1
      ORDER BY 4 DESC, 1 LIMIT 10""")(
    lambda t: tables.sos_compliance(t.guest_order, 14, t.order_clock).orderBy(F.desc("sos_breach_rate"), "unit_id").limit(10))
query("f_revenue_by_channel", f"""SELECT channel, count(*) orders, {S('total_amount')} revenue,
      {A('total_amount')} avg_order_value FROM guest_order WHERE placed_at>={NOW_ORD}-{days(30)} GROUP BY 1""")(
    lambda t: tables.revenue_by_channel(t.guest_order, 30, t.order_clock))
query("f_top_menu_items", f"""SELECT menu_item_id, item_name, {I('quantity')} units_sold, {S('line_net_amount')} net_revenue
      FROM order_item JOIN menu_item USING (menu_item_id) WHERE unit_id=13 AND placed_at>={NOW_ORD}-{days(365)}
      GROUP BY 1,2 ORDER BY 4 DESC, 1 LIMIT 25""")(
    lambda t: tables.top_menu_items(t.order_item, t.menu_item, 13, 365, t.order_clock))
query("f_late_delivery_rate", f"""SELECT unit_id, count(*) deliveries, {C(LATE)} late_deliveries, {P(LATE)} late_rate
      FROM delivery_order WHERE created_at>={NOW_DEL}-{days(30)} GROUP BY 1""")(
    lambda t: tables.late_delivery_rate(t.delivery_order, 30, t.delivery_clock))
query("f_late_delivery_rate_worst", f"""SELECT unit_id, count(*) deliveries, {C(LATE)} late_deliveries, {P(LATE)} late_rate
      FROM delivery_order WHERE created_at>={NOW_DEL}-{days(90)} GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10""")(
    lambda t: tables.late_delivery_rate(t.delivery_order, 90, t.delivery_clock).orderBy(F.desc("late_rate"), "unit_id").limit(10))
query("f_loyalty_summary", f"""SELECT unit_id, count(DISTINCT member_id) active_members, {I(EARN)} points_earned,
      {I(BURN)} points_redeemed, coalesce({I(BURN)}/nullif({I(EARN)},0),0::DOUBLE) redemption_rate
      FROM loyalty_transaction WHERE transaction_at>={NOW_LOY}-{days(30)} GROUP BY 1""")(
    lambda t: tables.loyalty_summary(t.loyalty_transaction, 30, t.loyalty_clock))
query("f_member_vs_nonmember", f"""SELECT CASE WHEN member_id IS NOT NULL THEN 'member' ELSE 'non_member' END segment,
      count(*) orders, {S('total_amount')} revenue, {A('total_amount')} avg_order_value FROM guest_order
      WHERE placed_at>={NOW_ORD}-{days(30)} GROUP BY 1""")(
    lambda t: tables.member_vs_nonmember(t.guest_order, 30, t.order_clock))
query("f_tier_breakdown", f"""SELECT tier, count(DISTINCT member_id) members, count(*) transactions,
      {I('points_delta')} net_points FROM loyalty_transaction WHERE transaction_at>={NOW_LOY}-{days(30)} GROUP BY 1""")(
    lambda t: tables.tier_breakdown(t.loyalty_transaction, 30, t.loyalty_clock))
query("f_waste_by_category", f"""SELECT waste_category, count(*) events, {S('waste_quantity')} waste_qty,
      {S('waste_cost')} waste_cost FROM waste_log WHERE logged_at>={NOW_WST}-{days(30)} GROUP BY 1""")(
    lambda t: tables.waste_by_category(t.waste_log, 30, t.waste_clock))
query("f_top_waste_stores", f"""SELECT unit_id, count(*) events, {S('waste_cost')} waste_cost FROM waste_log
      WHERE logged_at>={NOW_WST}-{days(30)} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25""")(
    lambda t: tables.top_waste_stores(t.waste_log, 30, t.waste_clock))
query("f_below_par_skus", "SELECT * EXCLUDE (unit_id) FROM below_par WHERE unit_id=13")(
    lambda t: tables.below_par_skus(t.on_hand_balance, 13))
query("f_labor_hours", f"""SELECT unit_id, {S('hours_worked')} labor_hours, count(DISTINCT employee_id) employees,
      count(*) punches FROM time_punch WHERE punch_in>={NOW_EVT}-{days(7)} GROUP BY 1""")(
    lambda t: tables.labor_hours(t.time_punch, 7, t.event_clock))
query("f_sales_per_labor_hour", f"""SELECT unit_id, h labor_hours, r revenue, r/nullif(h,0) sales_per_labor_hour FROM
      (SELECT unit_id, {S('hours_worked')} h FROM time_punch WHERE punch_in>={NOW_EVT}-{days(30)} GROUP BY 1) JOIN
      (SELECT unit_id, {S('daily_revenue')} r FROM unit_performance_daily WHERE date>=CAST({NOW_ORD} AS DATE)-30 GROUP BY 1)
      USING (unit_id)""")(
    lambda t: tables.sales_per_labor_hour(t.time_punch, gold.unit_performance_daily(t.guest_order), 30, t.event_clock,
                                          t.order_clock))
query("f_overtime_employees", f"""SELECT employee_id, max(unit_id) unit_id, {S("hours_worked")} AS hours FROM time_punch
      WHERE punch_in>={NOW_EVT}-{days(7)} GROUP BY 1 HAVING {S('hours_worked')}>40""")(
    lambda t: tables.overtime_employees(t.time_punch, 7, t.event_clock))
query("f_overtime_headcount", f"""SELECT count(*) overtime_employees FROM (SELECT employee_id FROM time_punch
      WHERE punch_in>={NOW_EVT}-{days(7)} GROUP BY 1 HAVING {S('hours_worked')}>40)""")(
    lambda t: tables.overtime_employees(t.time_punch, 7, t.event_clock).agg(tables.rows().alias("overtime_employees")))
query("f_demand_risk", "SELECT * FROM risk_outlook")(
    lambda t: tables.demand_risk(t.demand_risk_forecast, t.today, 7))
query("f_franchisee_scorecard", "SELECT * FROM scorecard")(lambda t: scorecard(t))
query("f_tender_mix", f"""SELECT tender_type, count(*) payments, {S('amount')} amount,
      CAST(sum(sum(CAST(floor(amount*10000+0.5) AS BIGINT))) OVER (PARTITION BY tender_type) AS BIGINT)
      /CAST(sum(sum(CAST(floor(amount*10000+0.5) AS BIGINT))) OVER () AS BIGINT) pct_of_amount
      FROM payment WHERE paid_at>={NOW_PAY}-{days(30)} GROUP BY 1""")(
    lambda t: tables.tender_mix(t.payment, 30, t.paid_clock))
query("f_guest_churn", f"""SELECT unit_id, count(*) total_profiles, {C("account_status='active'")} active_profiles,
      {C("account_status='inactive'")} inactive_profiles, {C("account_status='suspended'")} suspended_profiles,
      {P("account_status='inactive'")} inactive_rate FROM guest_profile
      WHERE created_at>={NOW_EVT}-{days(30)} GROUP BY 1""")(
    lambda t: tables.guest_churn(t.guest_profile, 30, t.event_clock))
query("f_guest_churn_all_time", f"""SELECT unit_id, count(*) total_profiles, {C("account_status='active'")} active_profiles,
      {C("account_status='inactive'")} inactive_profiles, {C("account_status='suspended'")} suspended_profiles,
      {P("account_status='inactive'")} inactive_rate FROM guest_profile GROUP BY 1""")(
    lambda t: tables.guest_churn(t.guest_profile, 3650, t.event_clock))


def scorecard(t, n: int = 30):
    return tables.franchisee_scorecard(t.guest_order, t.waste_log, t.time_punch, t.unit, n, t.order_clock, t.waste_clock,
                                       t.event_clock)
