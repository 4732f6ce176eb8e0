"""Deterministic business derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelake.functions.numeric import fixed, half_up

# Share of peak volume by hour 0..23 and by weekday Monday..Sunday.
HOURLY = (0.05, 0.12, 0.10, 0.03, 0.02, 0.02, 0.08, 0.12, 0.15, 0.18, 0.22, 0.55,
          0.80, 0.70, 0.42, 0.30, 0.35, 0.65, 0.90, 1.00, 0.95, 0.75, 0.60, 0.45)
WEEKDAY = (1.0, 1.1, 1.2, 1.25, 1.45, 1.6, 1.35)

# Base channel mix, order-rate, tax, surcharge, par and shift rules.
CHANNEL_MIX = {"3pd_delivery": 0.40, "own_delivery": 0.16, "carryout": 0.40, "catering": 0.04}
LATE_SHIFT = 0.15
BASE_ORDERS_PER_HOUR = 18
TAX_PER_MILLE = 85
MARKETPLACE_SURCHARGE_CENTS = 125
PAR_LEVEL, REORDER_SHARE = 20.0, 0.25
WASTE_UNIT_COST = 2.5
SHIFT_WINDOWS = (("open", "10:00", "16:00"), ("mid", "14:00", "21:00"),
                 ("close", "17:00", "23:00"), ("overlap", "12:00", "20:00"))

# Dated events as (month, day, name, multiplier).
FIXED_DAYS = ((10, 31, "halloween", 1.8), (12, 24, "christmas_eve", 1.1),
              (12, 25, "christmas_day", 0.7), (12, 31, "new_years_eve", 2.3))


def by_index(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def financial_periods(span: DataFrame, today: Column | None = None) -> DataFrame:
    """Monthly periods covering the one-row ``span(first_day, last_day)``."""
    months = F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.expr("interval 1 month"))
    now = F.col("last_day") if today is None else today
    end = F.last_day("start")
    return span.select("last_day", F.posexplode(months).alias("i", "start")).select(
        (F.col("i") + 1).cast("bigint").alias("financial_period_id"),
        F.date_format("start", "MMM yyyy").alias("period_name"),
        F.col("start").cast("string").alias("start_date"), end.cast("string").alias("end_date"),
        F.year("start").alias("fiscal_year"), F.quarter("start").alias("fiscal_quarter"),
        F.when(end < now, "closed").otherwise("open").alias("status"))


def fiscal_period(days: DataFrame, periods: DataFrame, day: str = "date") -> DataFrame:
    """Period containing each distinct day, else the last period."""
    spread = periods.select(
        F.explode(F.sequence(F.to_date("start_date"), F.to_date("end_date"))).alias(day), "financial_period_id")
    last = periods.agg(F.max_by("financial_period_id", "start_date")).scalar()
    return days.select(day).distinct().join(spread, day, "left").select(
        day, F.coalesce("financial_period_id", last).alias("financial_period_id"))


def classify_day(day: Column) -> Column:
    """Struct (is_holiday, holiday_name, event_multiplier); first matching rule wins."""
    m, d, w = F.month(day), F.dayofmonth(day), F.weekday(day)
    sunday, friday = w == 6, w == 4
    rules = [((m == 2) & sunday & d.between(8, 14), True, "super_bowl", 3.2)]
    rules += [((m == fm) & (d == fd), True, name, mult) for fm, fd, name, mult in FIXED_DAYS]
    rules += [
        ((m == 11) & friday & d.between(23, 29), True, "black_friday", 1.6),
        (sunday & (((m == 9) & (d >= 7)) | m.isin(10, 11, 12) | ((m == 1) & (d <= 15))), True, "nfl_sunday", 2.0),
        ((m == 6) & friday, False, "summer_friday", 1.4),
        (m == 1, False, None, 0.85),
    ]
    fact = lambda h, n, x: F.struct(F.lit(h).alias("is_holiday"), F.lit(n).cast("string").alias("holiday_name"),
                                    F.lit(x).cast("double").alias("event_multiplier"))
    out = fact(False, None, 1.0)
    for cond, *values in reversed(rules):
        out = F.when(cond, fact(*values)).otherwise(out)
    return out


def calendar_events(days: DataFrame, day: str = "date") -> DataFrame:
    return days.select("*", classify_day(F.col(day)).alias("c")).select(*days.columns, "c.*")


def strongest_event(calendar: Column, local: Column) -> Column:
    return F.greatest(calendar, F.coalesce(local, calendar))


def sos_expectation(event: Column) -> Column:
    return F.lit(0.08) + F.greatest(F.lit(0.0), (event - F.lit(1.5)) * F.lit(0.05))


def expected_demand(grid: DataFrame, unit: DataFrame, lookup: DataFrame,
                    base: int = BASE_ORDERS_PER_HOUR) -> DataFrame:
    """Expected orders per unit and hour.

    ``grid`` has (unit_id, hour_start); ``lookup`` is the weather and event table
    by metro and day.
    """
    rows = grid.join(unit.select("unit_id", "metro_area", "unit_volume_bias"), "unit_id").withColumn(
        "forecast_date", F.to_date("hour_start"))
    facts = lookup.select("metro_area", "forecast_date", "demand_multiplier", "channel_shift_delivery",
                          "event_demand_multiplier")
    rows = calendar_events(rows.join(facts, ["metro_area", "forecast_date"], "left"), "forecast_date")
    hour = F.hour("hour_start")
    event = strongest_event(F.col("event_multiplier"), F.col("event_demand_multiplier"))
    volume = (F.lit(float(base)) * by_index(HOURLY, hour) * by_index(WEEKDAY, F.weekday("forecast_date")) * event
              * F.col("unit_volume_bias") * F.coalesce("demand_multiplier", F.lit(1.0)))
    return rows.select(*grid.columns, hour.alias("hour_of_day"), "is_holiday", "holiday_name",
                       event.alias("event_multiplier"), volume.alias("expected_orders"),
                       sos_expectation(event).alias("sos_breach_probability"), "channel_shift_delivery")


def channel_mix(hour: Column, weather_shift: Column) -> dict[str, Column]:
    """Expected channel shares: late-night then weather move carry-out to delivery."""
    late = F.when((hour >= 22) | (hour <= 1), F.lit(LATE_SHIFT)).otherwise(F.lit(0.0))
    wet = F.greatest(F.lit(0.0), F.coalesce(weather_shift, F.lit(0.0)))
    up = lambda x, s: F.least(F.lit(1.0), x + s)
    down = lambda x, s: F.greatest(F.lit(0.0), x - s)
    mix = {c: F.lit(v) for c, v in CHANNEL_MIX.items()}
    mix["3pd_delivery"] = up(up(mix["3pd_delivery"], late), wet)
    mix["carryout"] = down(down(mix["carryout"], late), wet)
    return mix


def sold_in_daypart(daypart: Column, hour: Column) -> Column:
    return (daypart == "all_day") | ((daypart == "lunch") & hour.between(10, 14))


def price_line(order_item, guest_order, menu_item, item_price, unit) -> DataFrame:
    """Reprice lines: base x period multiplier x store index, plus the marketplace surcharge.

    Prices are rows of an item and a period each.  The planner sizes generated ones by their items, so they are merged, never
    broadcast.
    """
    lines = (
        order_item.select("order_item_id", "guest_order_id", "menu_item_id", "quantity")
        .join(guest_order.select("guest_order_id", "unit_id", "channel", "financial_period_id"), "guest_order_id")
        .join(menu_item.select("menu_item_id", "base_price"), "menu_item_id")
        .join(item_price.hint("merge"), ["menu_item_id", "financial_period_id"], "left")
        .join(unit.select("unit_id", "market_price_index"), "unit_id", "left"))
    mult = fixed(F.coalesce("price_multiplier", F.lit(1.0)))
    index = fixed(F.coalesce("market_price_index", F.lit(1.0)))
    cents = half_up(fixed("base_price", 100) * mult * index, F.lit(100_000_000))
    each = cents + F.when(F.col("channel") == "3pd_delivery", MARKETPLACE_SURCHARGE_CENTS).otherwise(0)
    return lines.select("order_item_id", "guest_order_id", "menu_item_id", "quantity",
                        (each / F.lit(100.0)).alias("unit_price"),
                        (each * F.col("quantity") / F.lit(100.0)).alias("line_gross_amount"))


def allocate_discount(order_item: DataFrame, guest_order: DataFrame) -> DataFrame:
    """Spread each order's discount over its lines by gross share.

    Order totals are aggregated and joined back, so an order with very many
    lines is never held in one window partition.
    """
    lines = order_item.select("order_item_id", "guest_order_id", fixed("line_gross_amount", 100).alias("gross"))
    totals = lines.groupBy("guest_order_id").agg(F.sum("gross").alias("order_gross")).join(
        guest_order.select("guest_order_id", fixed("discount_amount", 100).alias("asked")), "guest_order_id")
    rows = lines.join(totals, "guest_order_id").withColumn("granted", F.least("asked", "order_gross"))
    share = F.when(F.col("order_gross") > 0, half_up(F.col("gross") * F.col("granted"), F.col("order_gross"))).otherwise(0)
    return rows.select("order_item_id", "guest_order_id", (F.col("gross") / F.lit(100.0)).alias("line_gross_amount"),
                       (share / F.lit(100.0)).alias("line_discount_amount"),
                       ((F.col("gross") - share) / F.lit(100.0)).alias("line_net_amount"))


def order_totals(discounted: DataFrame, guest_order: DataFrame) -> DataFrame:
    """Subtotal of net lines, tax and total; a cancelled order totals 0."""
    sub = discounted.groupBy("guest_order_id").agg(F.sum(fixed("line_net_amount", 100)).alias("sub"))
    tax = half_up(F.col("sub") * TAX_PER_MILLE, F.lit(1000))
    total = F.when(F.col("order_status") == "cancelled", 0).otherwise(F.col("sub") + tax)
    return sub.join(guest_order.select("guest_order_id", "order_status"), "guest_order_id").select(
        "guest_order_id", "order_status", (F.col("sub") / F.lit(100.0)).alias("subtotal"),
        (tax / F.lit(100.0)).alias("tax_amount"), (total / F.lit(100.0)).alias("total_amount"))


def bom_depletion(order_item: DataFrame, recipe: DataFrame, tick: str = "hour") -> DataFrame:
    """Ingredient use per unit, tick and SKU.  Lines are added up per item before
    the recipe multiplies them."""
    sold = order_item.groupBy("unit_id", F.date_trunc(tick, "placed_at").alias("tick"), "menu_item_id").agg(
        F.sum("quantity").alias("sold"))
    used = F.sum(fixed(F.col("quantity")) * F.col("sold")) / F.lit(10_000)
    return sold.join(recipe.select("menu_item_id", "stock_sku", "quantity"), "menu_item_id").groupBy(
        "unit_id", "tick", "stock_sku").agg(used.alias("quantity_used"))


def replenishment(depletion: DataFrame, par: float = PAR_LEVEL) -> DataFrame:
    """Stock left after use, and an order up to par where it fell below a quarter."""
    left = F.round(F.greatest(F.lit(0.0), F.lit(par) - F.col("quantity_used")), 3)
    return depletion.withColumn("quantity_on_hand", left).filter(
        F.col("quantity_on_hand") < par * REORDER_SHARE).withColumn(
        "order_quantity", F.round(F.lit(par) - F.col("quantity_on_hand"), 3))


def waste_cost(quantity: Column) -> Column:
    return half_up(fixed(quantity) * int(WASTE_UNIT_COST * 10), F.lit(1000)) / F.lit(100.0)


def hours_worked(punch_in: Column, punch_out: Column, wrap_days: bool = False) -> Column:
    """Hours between punches, two decimals; ``wrap_days`` drops whole days."""
    secs = F.unix_timestamp(punch_out) - F.unix_timestamp(punch_in)
    if wrap_days:
        secs = F.pmod(secs, F.lit(86_400))
    return half_up(secs, F.lit(36)) / F.lit(100.0)


def staff_plan(daily_orders: DataFrame) -> DataFrame:
    """Shifts per unit and day: one person per 25 orders, three to fifteen, windows in turn."""
    staff = F.least(F.lit(15), F.greatest(F.lit(3), F.floor(F.col("order_count") / 25))).cast("int")
    slot = F.col("slot") % len(SHIFT_WINDOWS)
    return daily_orders.select("unit_id", "date", F.explode(F.sequence(F.lit(0), staff - 1)).alias("slot")).select(
        "unit_id", "date", "slot", *[by_index([w[i] for w in SHIFT_WINDOWS], slot).alias(n)
                                     for i, n in enumerate(("shift_label", "shift_start", "shift_end"))])


def region_assignment(unit: DataFrame) -> DataFrame:
    """Districts number the metros alphabetically; four districts make a region.

    Only the distinct metros, a handful, are ranked in one place.
    """
    metros = unit.select("metro_area").distinct().withColumn(
        "district_id", F.row_number().over(Window.orderBy("metro_area")).cast("bigint"))
    return unit.select("unit_id", "metro_area").join(metros, "metro_area").withColumn(
        "region_id", F.floor((F.col("district_id") - 1) / 4) + 1)


def price_drift(drifts: DataFrame) -> DataFrame:
    """Compound per-item drift with a clamp after every period.

    The clamp makes the step order-dependent, so each item's periods - one per
    month - are folded in order inside its own row.
    """
    steps = F.array_sort(F.collect_list(F.struct("financial_period_id", fixed("drift", 100).alias("d"))))
    step = lambda m, d: F.least(F.lit(14_000), F.greatest(F.lit(7_000), half_up(m * (100 + d), F.lit(100))))
    empty = F.array().cast("array<struct<financial_period_id:bigint,m:bigint>>")
    start = F.struct(F.lit(10_000).cast("bigint").alias("m"), empty.alias("path"))

    def fold(acc, s):
        m = step(acc["m"], s["d"])
        point = F.struct(s["financial_period_id"].alias("financial_period_id"), m.alias("m"))
        return F.struct(m.alias("m"), F.concat(acc["path"], F.array(point)).alias("path"))

    path = F.aggregate("steps", start, fold, lambda acc: acc["path"])
    return drifts.groupBy("menu_item_id").agg(steps.alias("steps")).select(
        "menu_item_id", F.explode(path).alias("p")).select(
        "menu_item_id", "p.financial_period_id", (F.col("p.m") / F.lit(10_000.0)).alias("price_multiplier"))


def reward_value(points: Column) -> Column:
    return points / F.lit(100.0)


def redemption_ledger(redemptions: DataFrame) -> DataFrame:
    """Each redemption as a reward value and as its negative ledger row."""
    value = redemptions.select("member_id", "guest_order_id", F.lit("reward").alias("entry"),
                               F.lit(0).cast("bigint").alias("points_delta"),
                               reward_value(F.col("points_redeemed")).alias("reward_value"))
    ledger = redemptions.select("member_id", "guest_order_id", F.lit("redeem").alias("entry"),
                                (-F.col("points_redeemed")).cast("bigint").alias("points_delta"),
                                F.lit(0.0).alias("reward_value"))
    return value.unionByName(ledger)


