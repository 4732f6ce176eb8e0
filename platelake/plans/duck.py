"""The same domain tables as DuckDB common table expressions, for checking.

``oracle(body)`` prefixes a query with the tables it names.  Helpers write the
exact arithmetic of :mod:`platelake.functions.numeric` in SQL.
"""

from __future__ import annotations

import re

from platelake.functions import weather as wx
from platelake.plans.payload_feeds import SEAT_TYPES


def fx(c: str, scale: int = 10000) -> str:
    return f"CAST(floor(({c})*{scale}+0.5) AS BIGINT)"


def S(c: str) -> str:  # noqa: N802
    """Exact sum."""
    return f"(CAST(sum({fx(c)}) AS BIGINT)/10000)"


def A(c: str) -> str:  # noqa: N802
    """Exact average."""
    return f"(CAST(sum({fx(c)}) AS BIGINT)/10000/count({c}))"


def P(p: str) -> str:  # noqa: N802
    """Share of rows where the predicate holds."""
    return f"(count(*) FILTER (WHERE {p})/count(*))"


def C(p: str) -> str:  # noqa: N802
    return f"count(*) FILTER (WHERE {p})"


def I(c: str) -> str:  # noqa: N802, E743
    return f"CAST(sum({c}) AS BIGINT)"


def R(c: str, digits: int) -> str:  # noqa: N802
    """Round half up on the decimal text, as Spark does."""
    return f"CAST(round(CAST({c} AS DECIMAL(38,9)),{digits}) AS DOUBLE)"


def HU(num: str, den: str) -> str:  # noqa: N802
    """Integer division rounded half up."""
    return f"CAST((2*CAST({num} AS BIGINT)+CAST({den} AS BIGINT))//(2*CAST({den} AS BIGINT)) AS BIGINT)"


def sha(*parts: str) -> str:
    return "sha256(" + "||':'||".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def mid(*parts: str) -> str:
    return f"CAST('0x'||substr({sha(*parts)},1,14) AS BIGINT)"


def cases(col: str, table: dict, default: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return "CASE " + " ".join(f"WHEN {col}={q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


EARN = "CASE WHEN points_delta>0 THEN points_delta ELSE 0 END"
BURN = "CASE WHEN points_delta<0 THEN -points_delta ELSE 0 END"
LATE = "actual_delivery_seconds>estimated_delivery_seconds"
GAP = "(actual_delivery_seconds-estimated_delivery_seconds)"
NOW_ORD = "(SELECT max(placed_at) FROM guest_order)"
NOW_PAY = "(SELECT max(paid_at) FROM payment)"
NOW_DEL = "(SELECT max(created_at) FROM delivery_order)"
NOW_LOY = "(SELECT max(transaction_at) FROM loyalty_transaction)"
NOW_WST = "(SELECT max(logged_at) FROM waste_log)"
NOW_RCV = "(SELECT max(created_at) FROM receiving_order)"
NOW_EVT = "(SELECT max(ts) FROM events)"
TODAY = f"(CAST({NOW_ORD} AS DATE) - 14)"


def days(n: int) -> str:
    return f"INTERVAL {n} DAY"


_LINE_ID = "l.l_orderkey,l.l_linenumber,l.l_partkey,l.l_suppkey"


def _line_id(kind: str) -> str:
    return mid(f"'{kind}'", *_LINE_ID.split(","))


_COND = "CASE " + " ".join(
    f"WHEN weather_code BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in wx.WMO_RANGES) + " ELSE 'clear' END"

# Which listing type a report's crowd stands for.
KIND = "['" + "','".join(SEAT_TYPES) + "'][crowd]"
RISK = f"""SELECT u.unit_id, u.metro_area, u.franchisee_id, u.region_id, w.forecast_date,
        w.observation_type, w.weather_condition, w.alert_level, w.high_temp_f, w.low_temp_f, w.precipitation_inches,
        w.demand_multiplier weather_demand_multiplier, w.channel_shift_delivery, e.event_name, e.event_category, e.venue,
        e.est_attendance, e.est_demand_multiplier event_demand_multiplier, e.source event_source,
        round(k,4) combined_demand_multiplier,
        CASE WHEN k<0.8 THEN 'demand_risk' WHEN k>1.4 THEN 'capacity_risk' ELSE 'normal' END risk_level
        FROM unit u JOIN weather_conditions w USING (metro_area)
        LEFT JOIN local_events e ON e.metro_area=w.metro_area AND e.event_date=w.forecast_date,
        LATERAL (SELECT least(2.5::DOUBLE,greatest(0.3::DOUBLE,
            coalesce(w.demand_multiplier,1.0)*coalesce(e.est_demand_multiplier,1.0))) k)
        WHERE w.forecast_date BETWEEN {TODAY} AND {TODAY}+14"""

CTES = {
    "unit": """SELECT CAST(n_nationkey AS BIGINT) unit_id, n_name unit_name, n_name city, n_name state, r_name metro_area,
        CAST(n_regionkey AS BIGINT) region_id,
        CASE WHEN n_nationkey%5<>0 THEN CAST(n_nationkey%7 AS BIGINT) END franchisee_id,
        (8+n_nationkey%5)/10.0::DOUBLE unit_volume_bias, (85+(n_nationkey%9)*5)/100.0::DOUBLE market_price_index,
        25.0::DOUBLE+n_nationkey lat, -70.0::DOUBLE-n_nationkey lon
        FROM nation JOIN region ON n_regionkey=r_regionkey""",
    "franchisee": """SELECT DISTINCT franchisee_id, 'Group #'||franchisee_id franchisee_name FROM unit
        WHERE franchisee_id IS NOT NULL""",
    "menu_item": f"""SELECT p_partkey menu_item_id, p_name item_name,
        {cases('p_type', {'LARGE': 'pizza', 'MEDIUM': 'wings', 'PROMO': 'sides', 'STANDARD': 'salads',
                          'SMALL': 'drinks', 'ECONOMY': 'desserts'}, 'NULL')} category,
        p_brand subcategory, p_retailprice base_price, {fx('p_retailprice', 100)}*3/1000.0::DOUBLE AS cost,
        CASE WHEN p_size<=10 THEN 'lunch' ELSE 'all_day' END daypart, p_partkey%7<>2 is_3pd_available,
        p_partkey%7<>3 is_olo_available, p_partkey%7<>1 is_delivery_available, p_partkey%7<>0 is_carryout_available
        FROM part""",
    "recipe_ingredient": f"""SELECT p_partkey*3+i recipe_ingredient_id, p_partkey menu_item_id,
        'sku_'||((p_partkey+i)%9) stock_sku, (i+1)/10.0::DOUBLE quantity,
        {fx('p_retailprice', 100)}/1000.0::DOUBLE cost_per_unit FROM part, range(3) r(i)""",
    "financial_period": """SELECT CAST(row_number() OVER (ORDER BY d) AS BIGINT) financial_period_id,
        strftime(d,'%b %Y') period_name, CAST(CAST(d AS DATE) AS VARCHAR) start_date,
        CAST(CAST(last_day(d) AS DATE) AS VARCHAR) end_date, CAST(year(d) AS INTEGER) fiscal_year,
        CAST(quarter(d) AS INTEGER) fiscal_quarter, CASE WHEN last_day(d)<hi THEN 'closed' ELSE 'open' END status
        FROM (SELECT unnest(generate_series(date_trunc('month',lo),date_trunc('month',hi),INTERVAL 1 MONTH)) d, hi
              FROM (SELECT CAST(min(o_orderdate) AS DATE) lo, CAST(max(o_orderdate) AS DATE) hi FROM orders))""",
    "item_price": """SELECT p_partkey menu_item_id, CAST(i AS BIGINT) financial_period_id,
        (90+(p_partkey+i)%20)/100.0::DOUBLE price_multiplier
        FROM part, (SELECT unnest(range(1,(SELECT max((year(o_orderdate)-1995)*12+month(o_orderdate))+1 FROM orders))) i)""",
    "guest_order": f"""SELECT o_orderkey guest_order_id, unit_id, channel,
        CASE WHEN channel LIKE '%delivery' THEN 'delivery' ELSE channel END order_type,
        CASE WHEN o_orderstatus='P' THEN 'cancelled' ELSE 'fulfilled' END order_status,
        CASE WHEN o_custkey%10<4 THEN o_custkey END profile_id, CASE WHEN o_custkey%10<2 THEN o_custkey END member_id,
        sub/100.0::DOUBLE subtotal, CASE WHEN o_orderkey%10=0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END discount_amount,
        (cents-sub)/100.0::DOUBLE tax_amount, o_totalprice total_amount, placed_at,
        CASE WHEN o_orderstatus<>'P' THEN placed_at+to_seconds(prep) END ready_at,
        CASE WHEN o_orderstatus<>'P' THEN placed_at+to_seconds(prep+120) END fulfilled_at,
        CASE WHEN o_orderstatus='P' THEN placed_at END cancelled_at,
        CAST((year(placed_at)-1995)*12+month(placed_at) AS BIGINT) financial_period_id, o_orderkey%12=0 sos_breach,
        placed_at created_at, franchisee_id, region_id, prep
        FROM (SELECT *, CAST(c_nationkey AS BIGINT) unit_id, o_orderdate+to_hours(CAST(o_orderkey%24 AS INTEGER)) placed_at,
              CASE o_orderpriority WHEN '1-URGENT' THEN '3pd_delivery' WHEN '2-HIGH' THEN 'own_delivery'
                   WHEN '5-LOW' THEN 'catering' ELSE 'carryout' END channel,
              {fx('o_totalprice', 100)} cents,
              CAST(floor({fx('o_totalprice', 100)}*1000/1085.0::DOUBLE+0.5) AS BIGINT) sub,
              CAST(600+o_orderkey%1800 AS INTEGER) prep
              FROM orders LEFT JOIN customer ON o_custkey=c_custkey) LEFT JOIN unit USING (unit_id)
        WHERE o_totalprice>=0 AND unit_id IS NOT NULL""",
    "order_item": f"""SELECT {_line_id('oi')} order_item_id, l_orderkey guest_order_id, g.unit_id, l_partkey menu_item_id,
        CAST(l_quantity AS INTEGER) quantity,
        floor({fx('l_extendedprice', 100)}/CAST(l_quantity AS BIGINT)+0.5)/100.0::DOUBLE unit_price,
        l_extendedprice line_gross_amount,
        {fx('l_extendedprice', 100)}*(100-{fx('l_discount', 100)})/10000.0::DOUBLE line_net_amount,
        {fx('l_extendedprice', 100)}*{fx('l_discount', 100)}/10000.0::DOUBLE line_discount_amount,
        g.order_status item_status, l_partkey%50=0 waste_flag, g.placed_at, g.placed_at created_at
        FROM lineitem l JOIN guest_order g ON l_orderkey=guest_order_id""",
    "payment": """SELECT guest_order_id payment_id, guest_order_id, unit_id,
        ['credit_card','digital_wallet','loyalty_redemption','cash'][guest_order_id%4+1] tender_type,
        total_amount amount, CAST(CAST(placed_at AS DATE) AS VARCHAR) settlement_date, placed_at paid_at,
        placed_at created_at FROM guest_order WHERE order_status<>'cancelled'""",
    "status_event": """SELECT guest_order_id*10+j status_event_id, guest_order_id, unit_id, prior_state, current_state,
        placed_at+to_seconds(secs) event_timestamp, secs elapsed_seconds_in_prior_state,
        CASE WHEN channel='carryout' THEN 720 ELSE 1800 END sos_target_seconds,
        sos_breach AND current_state='ready' is_sos_breach, placed_at created_at
        FROM (SELECT *, 0 j, 'placed' prior_state, 'preparing' current_state, CAST(60 AS INTEGER) secs FROM guest_order
              UNION ALL SELECT *, 1, 'preparing', 'ready', prep FROM guest_order
              UNION ALL SELECT *, 2, 'ready', 'fulfilled', 120 FROM guest_order) WHERE order_status<>'cancelled'""",
    "delivery_order": """SELECT guest_order_id delivery_order_id, guest_order_id, unit_id,
        CASE WHEN channel='3pd_delivery' THEN 'P'||guest_order_id END platform_order_reference,
        CAST(1800+guest_order_id%900 AS INTEGER) estimated_delivery_seconds,
        CAST(1800+guest_order_id%900-300+(guest_order_id*7)%1201 AS INTEGER) actual_delivery_seconds,
        'delivered' delivery_status, placed_at created_at FROM guest_order WHERE channel LIKE '%delivery'""",
    "on_hand_balance": f"""SELECT {_line_id('ohb')} on_hand_balance_id, g.unit_id, 'sku_'||(l_partkey%9) stock_sku,
        l_quantity quantity_on_hand, l_quantity/10.0::DOUBLE quantity_reserved, 20.0::DOUBLE par_level,
        l_shipdate snapshot_at, l_shipdate created_at
        FROM lineitem l JOIN guest_order g ON l_orderkey=guest_order_id WHERE l_returnflag='A' AND l_quantity>=0""",
    "waste_log": f"""SELECT {_line_id('wl')} waste_log_id, g.unit_id, 'sku_'||(l_partkey%9) stock_sku,
        l_quantity*4/100.0::DOUBLE waste_quantity,
        ['overproduction','spoilage','theft','expired','damaged'][l_partkey%5+1] waste_category,
        l_quantity/10.0::DOUBLE waste_cost, l_shipdate+to_hours(CAST(l_partkey%24 AS INTEGER)) logged_at,
        l_shipdate+to_hours(CAST(l_partkey%24 AS INTEGER)) created_at, g.franchisee_id, g.region_id
        FROM lineitem l JOIN guest_order g ON l_orderkey=guest_order_id WHERE l_returnflag='R'""",
    "receiving_order": f"""SELECT {_line_id('rcv')} receiving_order_id, g.unit_id, 'sku_'||(l_partkey%9) stock_sku,
        l_quantity received_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) delivery_date,
        CASE WHEN l_partkey%50=0 THEN 'fail' ELSE 'pass' END quality_inspection_result,
        l_suppkey%25<>0 temperature_check_pass, l_shipdate created_at
        FROM lineitem l JOIN guest_order g ON l_orderkey=guest_order_id WHERE l_returnflag='N'""",
    "replenishment_order": f"""SELECT {_line_id('rep')} replenishment_order_id, g.unit_id, 'sku_'||(l_partkey%9) stock_sku,
        'auto_par' order_type, 20.0::DOUBLE-l_quantity order_quantity,
        CASE WHEN l_partkey%3=0 THEN 'open' ELSE 'submitted' END order_status, l_shipdate ordered_at,
        l_shipdate created_at
        FROM lineitem l JOIN guest_order g ON l_orderkey=guest_order_id WHERE l_returnflag='A' AND l_quantity<5""",
    "profile_change": """SELECT user_id guest_profile_id, user_id*10+1 digital_account_id, user_id%25 unit_id,
        'First'||user_id first_name, 'Last'||user_id last_name,
        CASE WHEN event_type<>'error' THEN 'user'||user_id||'@example.com' END email,
        CASE WHEN event_type<>'error' THEN '(555) 010-'||lpad(CAST(user_id%10000 AS VARCHAR),4,'0') END phone,
        lpad(CAST(user_id%100000 AS VARCHAR),5,'0') zip_code, CAST(CAST(ts AS DATE) AS VARCHAR) created_date,
        CASE event_type WHEN 'view' THEN 'inactive' WHEN 'error' THEN 'suspended' ELSE 'active' END account_status,
        ts created_at FROM events""",
    "guest_profile": """SELECT p.*, franchisee_id, region_id FROM (SELECT * FROM profile_change
        QUALIFY row_number() OVER (PARTITION BY guest_profile_id ORDER BY created_at DESC)=1) p
        LEFT JOIN unit USING (unit_id)""",
    "digital_account": """SELECT digital_account_id, guest_profile_id, account_status, created_date, created_at
        FROM profile_change""",
    "member_order": f"""SELECT guest_order_id, member_id, unit_id, placed_at, {fx('total_amount', 100)} cents,
        CASE WHEN (member_id*47)%4000>=3500 THEN 'platinum' WHEN (member_id*47)%4000>=1500 THEN 'gold'
             WHEN (member_id*47)%4000>=500 THEN 'silver' ELSE 'bronze' END tier
        FROM guest_order WHERE member_id IS NOT NULL AND total_amount>0""",
    "loyalty_transaction": f"""SELECT x.*, transaction_at created_at, franchisee_id, region_id FROM (
        SELECT {mid("'lt_earn'", 'guest_order_id', 'member_id')} loyalty_transaction_id, member_id, guest_order_id,
        unit_id, 'earn' transaction_type,
        CAST(floor(cents*CASE tier WHEN 'platinum' THEN 8 WHEN 'gold' THEN 6 WHEN 'silver' THEN 5 ELSE 4 END/40) AS INTEGER)
          points_delta, placed_at transaction_at, tier FROM member_order
        UNION ALL SELECT {mid("'lt_redeem'", 'guest_order_id', 'member_id')}, member_id, guest_order_id, unit_id, 'redeem',
        -[100,200,500][guest_order_id%3+1], placed_at, tier FROM member_order WHERE guest_order_id%13=0) x
        LEFT JOIN unit USING (unit_id)""",
    "reward_redemption": f"""SELECT {mid("'rr'", 'guest_order_id', 'member_id')} reward_redemption_id, member_id,
        guest_order_id, unit_id, [100,200,500][guest_order_id%3+1] points_redeemed,
        [100,200,500][guest_order_id%3+1]/100.0::DOUBLE reward_value, placed_at redeemed_at, placed_at created_at
        FROM member_order WHERE guest_order_id%13=0""",
    "shift": """SELECT event_id shift_id, user_id%25 unit_id, user_id employee_id,
        ['open','mid','close','overlap'][event_id%4+1] shift_label, ts shift_start, ts+to_hours(8) shift_end,
        CASE WHEN event_id%25=0 THEN 'no_show' ELSE 'completed' END status,
        CAST(CAST(ts AS DATE) AS VARCHAR) date, ts created_at FROM events""",
    "time_punch": f"""SELECT event_id time_punch_id, user_id employee_id, unit_id, ts punch_in,
        ts+to_seconds(CAST(floor({fx('value', 100)}*36/10) AS INTEGER)) punch_out,
        {fx('value', 100)}/1000.0::DOUBLE hours_worked, ts created_at, franchisee_id, region_id
        FROM (SELECT *, user_id%25 unit_id FROM events) LEFT JOIN unit USING (unit_id)""",
    "weather_feed": """SELECT guest_order_id observation_id, metro_area, state, CAST(placed_at AS DATE) forecast_date,
        CAST(guest_order_id%100 AS INTEGER) weather_code, 40.0::DOUBLE+guest_order_id%65 high_temp_f,
        10.0::DOUBLE+guest_order_id%30 low_temp_f, (guest_order_id%40)/10.0::DOUBLE precipitation_inches
        FROM guest_order JOIN unit USING (unit_id)""",
    "daily_weather": f"""SELECT metro_area, forecast_date,
        CASE WHEN forecast_date<{TODAY} THEN 'historical' ELSE 'forecast' END observation_type,
        high_temp_f, low_temp_f, precipitation_inches,
        CASE WHEN high_temp_f>100 THEN 'extreme_heat' WHEN low_temp_f<15 THEN 'extreme_cold' ELSE {_COND} END weather_condition
        FROM (SELECT * FROM weather_feed QUALIFY row_number() OVER
              (PARTITION BY metro_area, forecast_date ORDER BY observation_id DESC)=1)""",
    "alert_feed": """SELECT guest_order_id alert_id, state,
        ['Heat Advisory','Winter Storm Warning','Flood Watch','Special Statement'][(guest_order_id//10)%4+1] event,
        CAST(placed_at AS DATE) onset_date,
        CASE WHEN guest_order_id%9<>0 THEN CAST(placed_at AS DATE)+CAST(guest_order_id%4 AS INTEGER) END expires_date
        FROM guest_order JOIN unit USING (unit_id) WHERE guest_order_id%10=0""",
    "active_alert": """SELECT metro_area, severity, onset_date, expires_date FROM (
        SELECT *, CASE WHEN lower(event) LIKE '%warning%' THEN 3 WHEN lower(event) LIKE '%watch%' THEN 2
        WHEN lower(event) LIKE '%advisory%' THEN 1 END severity FROM alert_feed)
        JOIN (SELECT DISTINCT metro_area, state FROM unit) USING (state) WHERE severity IS NOT NULL""",
    "weather_alerted": """SELECT w.*, CASE s WHEN 3 THEN 'warning' WHEN 2 THEN 'watch' WHEN 1 THEN 'advisory' END alert_level
        FROM daily_weather w LEFT JOIN (SELECT d.metro_area, d.forecast_date, max(severity) s FROM daily_weather d
        JOIN active_alert a ON a.metro_area=d.metro_area AND d.forecast_date BETWEEN onset_date AND expires_date
        GROUP BY ALL) m ON m.metro_area=w.metro_area AND m.forecast_date=w.forecast_date""",
    "weather_conditions": f"""SELECT *, round(least(2.5,greatest(0.3,
        {cases('weather_condition', {k: v[0] for k, v in wx.CONDITIONS.items()}, '1.0')}::DOUBLE
        + {cases('alert_level', wx.ALERTS, '0.0')}::DOUBLE)),4) demand_multiplier,
        {cases('weather_condition', {k: v[1] for k, v in wx.CONDITIONS.items()}, '0.0')}::DOUBLE channel_shift_delivery
        FROM weather_alerted""",
    "happening_feed": """SELECT guest_order_id report_id, metro_area, state, CAST(placed_at AS DATE) event_date,
        'Event '||((guest_order_id//7)%6) event_name,
        ['nager','ticketmaster','seatgeek'][(guest_order_id//7)%3+1] source, 'Venue '||(guest_order_id%11) venue,
        guest_order_id%9+1 crowd FROM guest_order JOIN unit USING (unit_id) WHERE guest_order_id%7=0""",
    "event_report": f"""SELECT report_id, metro_area, event_date, event_name, source,
        substr(CASE WHEN source='nager' THEN {sha('source', 'event_date', 'event_name')}
               ELSE {sha('source', 'metro_area', 'event_date', 'event_name')} END,1,16) event_id,
        event_category, CASE WHEN source='nager' THEN '' ELSE venue END venue,
        CAST(CASE source WHEN 'nager' THEN 0 WHEN 'ticketmaster' THEN crowd*1000 ELSE 15000 END AS BIGINT) est_attendance,
        {cases('event_category', wx.EVENTS, '1.0')}::DOUBLE est_demand_multiplier
        FROM (SELECT *, CASE WHEN source='nager' THEN 'national_holiday'
              WHEN source='ticketmaster' AND crowd%2=1 THEN 'major_sports'
              WHEN source='seatgeek' AND crowd<=5 THEN 'major_sports' ELSE 'concert' END event_category FROM happening_feed)""",
    "local_events": """SELECT * EXCLUDE (report_id) FROM event_report QUALIFY row_number() OVER (PARTITION BY event_id
        ORDER BY source<>'seatgeek' DESC, CASE WHEN source='seatgeek' THEN -report_id ELSE report_id END DESC)=1""",
    "demand_risk_forecast": RISK,
    # Events as the payload parsers give them: the largest attendance, then venue, category and metro wins a key.
    "refreshed_events": f"""SELECT *, {cases('event_category', wx.EVENTS, '1.0')}::DOUBLE est_demand_multiplier FROM (
        SELECT metro_area, event_date, substr({sha('source', 'metro_area', 'event_date', 'event_name')},1,16) event_id, event_name,
        CASE WHEN source='ticketmaster' THEN CASE WHEN crowd%2=1 THEN 'major_sports' ELSE 'concert' END
             WHEN {KIND} IN ('concert','theater') THEN 'concert' ELSE 'major_sports' END event_category, venue,
        CAST(CASE WHEN source='seatgeek' THEN 15000 WHEN crowd=9 THEN 5000000 ELSE crowd*1000 END AS BIGINT) est_attendance, source
        FROM happening_feed WHERE source='ticketmaster' OR (source='seatgeek' AND {KIND} NOT IN ('circus','comedy'))
        UNION ALL SELECT u.metro_area, event_date, substr({sha("'nager'", 'event_date', 'event_name')},1,16), event_name,
        'national_holiday', '', CAST(0 AS BIGINT), source FROM happening_feed h JOIN (SELECT DISTINCT metro_area, state FROM unit) u
        USING (state) WHERE source='nager' AND report_id%3<>1)
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY est_attendance DESC, venue DESC, event_category DESC, metro_area DESC)=1""",
    "otel_logs": """SELECT CAST(event_id AS VARCHAR) trace_id, epoch_us(ts)*1000 time_unix_nano, ts event_ts,
        'web-'||(event_id-event_id%5) order_id,
        TRY_CAST(CASE WHEN event_id%19=0 THEN 'n/a' WHEN event_id%17=0 THEN '0' ELSE CAST(value AS VARCHAR) END AS DOUBLE) amount,
        CASE WHEN user_id%3<>0 THEN user_id END member_id, CAST(event_id%4+1 AS INTEGER) items_count,
        'TRK-'||event_id tracking_id,
        CASE WHEN event_id%23=0 THEN 'fee-test-' WHEN event_id%29=0 THEN 'c2-verify-' ELSE 'user-' END||user_id user_id
        FROM events WHERE event_type='purchase'""",
    "order_span": """SELECT CAST(event_id AS VARCHAR) trace_id, 'store-'||(user_id%40) store_id,
        CASE event_id%3 WHEN 0 THEN 'delivery' WHEN 1 THEN 'carryout' ELSE 'kiosk' END channel,
        CASE WHEN event_id%13<>0 THEN event_id%80 END m0, event_id%4 q0, (event_id+7)%80 m1, (event_id+1)%4 q1,
        CAST(600+event_id%2400 AS INTEGER) prep_seconds, CASE WHEN event_id%7<>0 THEN 1500 END sos_target,
        CAST(event_id%4+(event_id+1)%4 AS INTEGER) total_quantity, 'NATION_'||(user_id%30) state, 'City '||(user_id%30) city,
        lpad(CAST(user_id AS VARCHAR),5,'0') zip FROM events WHERE event_type='purchase' AND event_id%11<>0""",
    "stage_span": """SELECT CAST(event_id AS VARCHAR) trace_id, event_id, i,
        ['Prep','Bake','Quality Check','Out For Delivery','Delivered'][i] stage
        FROM events, range(1,6) r(i) WHERE event_type='purchase' AND event_id%4<>0 AND i<=event_id%6""",
    "customer_features": f"""SELECT profile_id, total_orders, {R('m', 4)} monetary_total, {R('m/total_orders', 4)} aov,
        CAST(coalesce(date_diff('day',last_at,CAST({NOW_ORD} AS DATE)),-1) AS INTEGER) recency_days,
        coalesce(tier,'none') tier, """ + ", ".join(
        f"coalesce(round({c}/nullif(total,0),6),0.0::DOUBLE) affinity_{c}"
        for c in ("pizza", "wings", "sides", "salads", "drinks", "desserts")) + f"""
        FROM (SELECT profile_id, count(*) total_orders, {S('total_amount')} m, CAST(max(placed_at) AS DATE) last_at
              FROM guest_order WHERE profile_id IS NOT NULL GROUP BY 1)
        LEFT JOIN (SELECT profile_id, {I(fx('line_net_amount'))} total, """ + ", ".join(
        f"coalesce({I(fx('line_net_amount'))} FILTER (WHERE category='{c}'),0) {c}".replace(
            f"{I(fx('line_net_amount'))} FILTER (WHERE category='{c}')",
            f"CAST(sum({fx('line_net_amount')}) FILTER (WHERE category='{c}') AS BIGINT)")
        for c in ("pizza", "wings", "sides", "salads", "drinks", "desserts")) + """
              FROM order_item JOIN guest_order USING (guest_order_id) JOIN menu_item USING (menu_item_id)
              WHERE profile_id IS NOT NULL GROUP BY 1) USING (profile_id)
        LEFT JOIN latest_tier ON member_id=profile_id""",
    "latest_tier": """SELECT member_id, tier FROM loyalty_transaction QUALIFY row_number() OVER
        (PARTITION BY member_id ORDER BY transaction_at DESC, loyalty_transaction_id DESC)=1""",
    "item_popularity": """SELECT unit_id, menu_item_id, quantity,
        round(quantity/greatest(max(quantity) OVER (PARTITION BY unit_id),1),6) popularity
        FROM (SELECT unit_id, menu_item_id, CAST(sum(quantity) AS BIGINT) quantity FROM order_item GROUP BY 1,2)""",
    "store_aov": f"""SELECT unit_id, count(*) store_orders, {R(A('total_amount'), 4)} store_aov FROM guest_order GROUP BY 1""",
    "unit_performance_daily": f"""SELECT unit_id, CAST(placed_at AS DATE) date, count(*) order_count,
        {S('total_amount')} daily_revenue, {A('total_amount')} avg_order_value, {C("order_status='cancelled'")} cancelled_count
        FROM guest_order GROUP BY 1,2""",
    "below_par": """SELECT unit_id, stock_sku, quantity_on_hand, par_level, par_level-quantity_on_hand shortfall
        FROM (SELECT * FROM on_hand_balance QUALIFY row_number() OVER (PARTITION BY unit_id, stock_sku
              ORDER BY snapshot_at DESC, on_hand_balance_id DESC)=1) WHERE quantity_on_hand<par_level""",
    "scorecard": f"""SELECT o.*, waste_cost, labor_hours FROM
        (SELECT u.franchisee_id, count(DISTINCT unit_id) stores, {S('total_amount')} revenue, count(*) orders,
         {A('total_amount')} avg_order_value, {P('sos_breach')} sos_breach_rate FROM guest_order JOIN unit u USING (unit_id)
         WHERE placed_at>={NOW_ORD}-{days(30)} GROUP BY 1) o
        LEFT JOIN (SELECT franchisee_id, {S('waste_cost')} waste_cost FROM waste_log WHERE logged_at>={NOW_WST}-{days(30)}
         GROUP BY 1) w ON w.franchisee_id=o.franchisee_id
        LEFT JOIN (SELECT franchisee_id, {S('hours_worked')} labor_hours FROM time_punch WHERE punch_in>={NOW_EVT}-{days(30)}
         GROUP BY 1) l ON l.franchisee_id=o.franchisee_id""",
    "risk_outlook": f"""SELECT unit_id, max(metro_area) metro_area, count(*) risk_days,
        {A('combined_demand_multiplier')} avg_demand_multiplier, {C("risk_level='demand_risk'")} demand_risk_days,
        {C("risk_level='capacity_risk'")} capacity_risk_days FROM demand_risk_forecast
        WHERE forecast_date BETWEEN {TODAY} AND {TODAY}+7 GROUP BY 1""",
    "web_dedup": """SELECT order_id web_order_id, max(trace_id) trace_id, max(member_id) member_id, max(amount) web_amount,
        max(items_count) web_item_count, max(tracking_id) web_tracking_id, max(event_ts) web_order_ts
        FROM otel_logs WHERE amount>0 GROUP BY 1""",
    "live_header": """SELECT web_order_id, trace_id, store_id web_store_id, city web_store_city, state web_store_state,
        zip web_store_zip, CASE WHEN channel='delivery' THEN 'own_delivery' ELSE coalesce(channel,'carryout') END channel,
        web_amount, web_item_count, total_quantity web_total_quantity, stage order_stage, web_order_ts, member_id,
        cf.profile_id IS NOT NULL customer_matched, cf.tier customer_tier, cf.total_orders customer_total_orders,
        cf.monetary_total customer_lifetime_spend
        FROM web_dedup LEFT JOIN order_span USING (trace_id)
        LEFT JOIN (SELECT * FROM stage_span QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY i DESC)=1) s USING (trace_id)
        LEFT JOIN customer_features cf ON cf.profile_id=member_id""",
    "live_item": f"""SELECT web_order_id, trace_id, l.menu_item_id, item_name, category, CAST(q AS INTEGER) quantity,
        base_price unit_price, {R('base_price*q', 2)} line_amount
        FROM web_dedup JOIN (SELECT trace_id, m0 menu_item_id, q0 q FROM order_span WHERE m0 IS NOT NULL
                             UNION ALL SELECT trace_id, m1, q1 FROM order_span WHERE m0 IS NOT NULL) l USING (trace_id)
        LEFT JOIN menu_item USING (menu_item_id)""",
    "reconciled": f"""SELECT web_order_id, trace_id, id guest_order_id, w.member_id, web_amount, web_item_count, web_tracking_id,
        web_order_ts, store_id web_store_id, city web_store_city, state web_store_state, zip web_store_zip,
        g.total_amount IS NOT NULL reconciled, g.unit_id, g.channel, g.order_status, g.total_amount silver_total_amount,
        g.placed_at silver_placed_at, {R('web_amount-g.total_amount', 2)} amount_diff,
        cf.profile_id IS NOT NULL customer_matched, cf.tier customer_tier, cf.total_orders customer_total_orders,
        cf.monetary_total customer_lifetime_spend
        FROM (SELECT *, {mid("'otel'", 'trace_id')} id FROM web_dedup) w LEFT JOIN order_span USING (trace_id)
        LEFT JOIN otel_order g ON g.guest_order_id=id LEFT JOIN customer_features cf ON cf.profile_id=w.member_id""",
    "unit_pool": """SELECT state pool, unit_id, row_number() OVER (PARTITION BY state ORDER BY unit_id)-1 slot,
        count(*) OVER (PARTITION BY state) n FROM (SELECT state, unit_id FROM unit UNION ALL SELECT '', unit_id FROM unit)""",
    "otel_base": f"""SELECT b.*, p.unit_id FROM (
        SELECT trace_id, event_ts, tracking_id, CASE WHEN member_id>0 THEN member_id END member_id,
        {mid("'otel'", 'trace_id')} guest_order_id, cents, {HU('cents*1000', '1085')} sub,
        coalesce(prep_seconds,0) prep, coalesce(sos_target,1800) target,
        coalesce(prep_seconds,0)>coalesce(sos_target,1800) breach,
        CASE WHEN channel='delivery' THEN 'own_delivery' ELSE 'carryout' END channel,
        coalesce((SELECT min(pool) FROM unit_pool WHERE pool=state),'') pool,
        {mid("'otel-store'", 'coalesce(store_id,trace_id)')} h, m0, q0, m1, q1,
        (SELECT count(*) FROM stage_span s WHERE s.trace_id=l.trace_id) stages
        FROM (SELECT *, {fx('amount', 100)} cents FROM otel_logs WHERE amount>0 AND user_id NOT LIKE 'fee-test%'
              AND user_id NOT LIKE 'c2-verify%') l LEFT JOIN order_span USING (trace_id)) b
        JOIN unit_pool p ON p.pool=b.pool AND p.slot=b.h%p.n""",
    "otel_order": """SELECT guest_order_id, unit_id, channel,
        CASE WHEN channel='own_delivery' THEN 'delivery' ELSE channel END order_type, 'fulfilled' order_status,
        member_id profile_id, member_id, sub/100.0::DOUBLE subtotal, 0.0::DOUBLE discount_amount,
        (cents-sub)/100.0::DOUBLE tax_amount, cents/100.0::DOUBLE total_amount, event_ts placed_at, breach sos_breach
        FROM otel_base""",
    "otel_line": f"""SELECT {mid("'otel-item'", 'trace_id', 'i')} order_item_id, guest_order_id, unit_id, m menu_item_id, q quantity,
        greatest(1,{HU('sub', 'total')})/100.0::DOUBLE unit_price, greatest(1,{HU('sub*q', 'total')})/100.0::DOUBLE line_net_amount
        FROM (SELECT *, sum(q) OVER (PARTITION BY trace_id)::BIGINT total,
              row_number() OVER (PARTITION BY trace_id ORDER BY pos)-1 i FROM (
              SELECT *, 0 pos, m0 m, q0 q FROM otel_base WHERE m0 IS NOT NULL
              UNION ALL SELECT *, 1, m1, q1 FROM otel_base WHERE m0 IS NOT NULL)
              WHERE q>0 AND m>0)""",
}


def oracle(body: str, text: tuple[str, ...] | list[str] = ()) -> str:
    """``body`` with the tables it needs in front; ``text`` columns become VARCHAR."""
    done: list[str] = []

    def walk(sql: str, stack: tuple[str, ...]):
        for name in CTES:
            if name not in stack and name not in done and re.search(rf"\b{name}\b", sql):
                walk(CTES[name], stack + (name,))
                done.append(name)

    walk(body, ())
    if text:
        casts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in text)
        body = f"SELECT * REPLACE ({casts}) FROM ({body})"
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in done)
    return f"WITH {head}\n{body}" if head else body
