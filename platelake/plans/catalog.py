"""Restaurant-shaped tables over the supplied parquet files.

``Tables`` derives the domain's envelope events and dimensions from the given
tables with deterministic column expressions and then runs the engine's own
silver functions over them.  Everything is lazy; a query plans only the
branches and columns it touches.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake import schemas
from platelake.functions.ids import make_id
from platelake.functions.loyalty import points_earned, tier_for_spend
from platelake.operators import derive, enrich, features, silver, views
from platelake.plans import payload_feeds
from platelake.sources import sinks

WASTE_CATEGORIES = ("overproduction", "spoilage", "theft", "expired", "damaged")
TENDERS = ("credit_card", "digital_wallet", "loyalty_redemption", "cash")
SHIFT_LABELS = ("open", "mid", "close", "overlap")
CATEGORY_OF_TYPE = {"LARGE": "pizza", "MEDIUM": "wings", "PROMO": "sides", "STANDARD": "salads",
                    "SMALL": "drinks", "ECONOMY": "desserts"}


# Columns of the given tables; declaring them saves a footer-reading job per table.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + F.lit(0.5))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.schema(GIVEN[name]).parquet(self.path(name))
        stamps = [c.split()[0] for c in GIVEN[name].split(", ") if c.endswith("timestamp_ntz")]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df

    # ---- clocks: newest event of each source, read from the narrowest table
    @cached_property
    def order_clock(self) -> Column:
        return self._placed(self.raw("orders")).agg(F.max("placed_at")).scalar()

    @cached_property
    def waste_clock(self) -> Column:
        rows = self.raw("lineitem").filter(F.col("l_returnflag") == "R")
        return rows.agg(F.max(self._logged_at())).scalar()

    @cached_property
    def ship_clock(self) -> Column:
        return self.raw("lineitem").filter(F.col("l_returnflag") == "N").agg(F.max("l_shipdate")).scalar()

    @cached_property
    def event_clock(self) -> Column:
        return self.raw("events").agg(F.max("ts")).scalar()

    @cached_property
    def loyalty_clock(self) -> Column:
        rows = self._placed(self.raw("orders")).filter(
            (F.col("o_custkey") % 10 < 2) & (F.col("o_totalprice") > 0))
        return rows.agg(F.max("placed_at")).scalar()

    @cached_property
    def paid_clock(self) -> Column:
        rows = self._placed(self.raw("orders")).filter(F.col("o_orderstatus") != "P")
        return rows.agg(F.max("placed_at")).scalar()

    @cached_property
    def delivery_clock(self) -> Column:
        rows = self._placed(self.raw("orders")).filter(
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        return rows.agg(F.max("placed_at")).scalar()

    @cached_property
    def today(self) -> Column:
        """Forecast date: two weeks before the last order day."""
        return F.date_sub(F.to_date(self.order_clock), 14)

    # ---- dimensions
    @cached_property
    def unit(self) -> DataFrame:
        k = F.col("n_nationkey").cast("bigint")
        region = self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self.raw("nation").join(region, "n_regionkey").select(
            k.alias("unit_id"),
            F.col("n_name").alias("unit_name"), F.col("n_name").alias("city"),
            F.col("n_name").alias("state"), F.col("r_name").alias("metro_area"),
            F.col("n_regionkey").cast("bigint").alias("region_id"),
            F.when(k % 5 != 0, k % 7).alias("franchisee_id"),
            ((8 + k % 5) / F.lit(10.0)).alias("unit_volume_bias"),
            ((85 + (k % 9) * 5) / F.lit(100.0)).alias("market_price_index"),
            (F.lit(25.0) + k).alias("lat"), (F.lit(-70.0) - k).alias("lon"),
        )

    @cached_property
    def franchisee(self) -> DataFrame:
        f = F.col("franchisee_id")
        return self.unit.filter(f.isNotNull()).select(f).distinct().select(
            f, F.concat(F.lit("Group #"), f.cast("string")).alias("franchisee_name"))

    @cached_property
    def menu_item(self) -> DataFrame:
        p = F.col("p_partkey")
        category = F.lit(None).cast("string")
        for kind, name in CATEGORY_OF_TYPE.items():
            category = F.when(F.col("p_type") == kind, F.lit(name)).otherwise(category)
        return self.raw("part").select(
            p.alias("menu_item_id"), F.col("p_name").alias("item_name"), category.alias("category"),
            F.col("p_brand").alias("subcategory"), F.col("p_retailprice").alias("base_price"),
            (cents("p_retailprice") * 3 / F.lit(1000.0)).alias("cost"),
            F.when(F.col("p_size") <= 10, "lunch").otherwise("all_day").alias("daypart"),
            (p % 7 != 2).alias("is_3pd_available"), (p % 7 != 3).alias("is_olo_available"),
            (p % 7 != 1).alias("is_delivery_available"), (p % 7 != 0).alias("is_carryout_available"),
        )

    @cached_property
    def recipe_ingredient(self) -> DataFrame:
        p = F.col("p_partkey")
        i = F.col("i")
        return self.raw("part").select(
            p, "p_retailprice", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")
        ).select(
            (p * 3 + i).alias("recipe_ingredient_id"), p.alias("menu_item_id"),
            F.concat(F.lit("sku_"), ((p + i) % 9).cast("string")).alias("stock_sku"),
            ((i + 1) / F.lit(10.0)).alias("quantity"),
            (cents("p_retailprice") / F.lit(1000.0)).alias("cost_per_unit"),
        )

    @cached_property
    def financial_period(self) -> DataFrame:
        span = self.raw("orders").agg(
            F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
        return derive.financial_periods(span)

    @cached_property
    def item_price(self) -> DataFrame:
        """One multiplier per item and month; the months of an item are generated in place."""
        last = self.raw("orders").agg(
            F.max((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate"))).scalar()
        grid = self.raw("part").select(
            F.col("p_partkey").alias("menu_item_id"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), last.cast("bigint"))).alias("financial_period_id"))
        return grid.withColumn(
            "price_multiplier",
            (90 + (F.col("menu_item_id") + F.col("financial_period_id")) % 20) / F.lit(100.0))

    # ---- order domain
    @staticmethod
    def _placed(orders: DataFrame) -> DataFrame:
        return orders.withColumn("placed_at", F.col("o_orderdate") + hours(F.col("o_orderkey") % 24))

    @cached_property
    def _orders(self) -> DataFrame:
        """Orders in domain terms; one row per order."""
        key, cust, prio = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
        home = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("unit_id"))
        channel = (F.when(prio == "1-URGENT", "3pd_delivery").when(prio == "2-HIGH", "own_delivery")
                   .when(prio == "5-LOW", "catering").otherwise("carryout"))
        cancelled = F.col("o_orderstatus") == "P"
        sub = F.floor(cents("o_totalprice") * 1000 / F.lit(1085.0) + F.lit(0.5))
        prep = F.lit(600) + key % 1800
        ready = F.when(~cancelled, F.col("placed_at") + seconds(prep))
        return self._placed(self.raw("orders")).join(home, "o_custkey", "left").select(
            key.alias("guest_order_id"), "unit_id", channel.alias("channel"),
            F.when(channel.like("%delivery"), "delivery").otherwise(channel).alias("order_type"),
            F.when(cancelled, "cancelled").otherwise("fulfilled").alias("order_status"),
            F.when(cust % 10 < 4, cust).alias("profile_id"), F.when(cust % 10 < 2, cust).alias("member_id"),
            (sub / F.lit(100.0)).alias("subtotal"),
            F.when(key % 10 == 0, F.lit(5.0)).otherwise(F.lit(0.0)).alias("discount_amount"),
            ((cents("o_totalprice") - sub) / F.lit(100.0)).alias("tax_amount"),
            F.col("o_totalprice").alias("total_amount"), "placed_at",
            ready.alias("ready_at"), (ready + seconds(F.lit(120))).alias("fulfilled_at"),
            F.when(cancelled, F.col("placed_at")).alias("cancelled_at"),
            ((F.year("placed_at") - 1995) * 12 + F.month("placed_at")).cast("bigint").alias("financial_period_id"),
            (key % 12 == 0).alias("sos_breach"), prep.alias("prep_seconds"),
        )

    @cached_property
    def _lines(self) -> DataFrame:
        """Line items with their order's unit, time and status."""
        orders = self._orders.select("guest_order_id", "unit_id", "placed_at", "order_status")
        return self.raw("lineitem").withColumnRenamed("l_orderkey", "guest_order_id").join(
            orders, "guest_order_id")

    @staticmethod
    def _line_id(kind: str) -> Column:
        return make_id(kind, F.col("guest_order_id"), F.col("l_linenumber"), F.col("l_partkey"),
                       F.col("l_suppkey"))

    @staticmethod
    def _logged_at() -> Column:
        return F.col("l_shipdate") + hours(F.col("l_partkey") % 24)

    def _head(self, df: DataFrame, event_type: str, event_id: str, ts: str) -> DataFrame:
        return df.select(F.lit(event_type).alias("event_type"), F.col(event_id).alias("event_id"),
                         F.col(ts).alias("event_ts"), "*")

    def events_of(self, event_type: str) -> DataFrame:
        """Envelope rows of one event type, staged columns only."""
        return getattr(self, f"_ev_{event_type}")()

    def _ev_guest_order(self):
        rows = self._orders.drop("prep_seconds").withColumn("source", F.lit("synth"))
        return self._head(rows, "guest_order", "guest_order_id", "placed_at")

    def _ev_order_item(self):
        gross, pct = cents("l_extendedprice"), F.floor(F.col("l_discount") * 100 + F.lit(0.5))
        qty = F.col("l_quantity").cast("bigint")
        rows = self._lines.select(
            self._line_id("oi").alias("order_item_id"), "guest_order_id", "unit_id",
            F.col("l_partkey").alias("menu_item_id"), qty.alias("quantity"),
            (F.floor(gross / qty + F.lit(0.5)) / F.lit(100.0)).alias("unit_price"),
            F.col("l_extendedprice").alias("line_gross_amount"),
            (gross * (100 - pct) / F.lit(10000.0)).alias("line_net_amount"),
            (gross * pct / F.lit(10000.0)).alias("line_discount_amount"),
            F.col("order_status").alias("item_status"), (F.col("l_partkey") % 50 == 0).alias("waste_flag"),
            "placed_at", F.lit("synth").alias("source"))
        return self._head(rows, "order_item", "order_item_id", "placed_at")

    def _served(self):
        return self._orders.filter(F.col("order_status") != "cancelled")

    def _ev_payment(self):
        key = F.col("guest_order_id")
        rows = self._served().select(
            key.alias("payment_id"), key, "unit_id", pick(TENDERS, key % 4).alias("tender_type"),
            F.col("total_amount").alias("amount"),
            F.to_date("placed_at").cast("string").alias("settlement_date"),
            F.col("placed_at").alias("paid_at"), F.lit("synth").alias("source"))
        return self._head(rows, "payment", "payment_id", "paid_at")

    def _ev_status_event(self):
        key = F.col("guest_order_id")
        steps = [("placed", "preparing", F.lit(60)), ("preparing", "ready", F.col("prep_seconds")),
                 ("ready", "fulfilled", F.lit(120))]
        step = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(a).alias("prior_state"),
                                  F.lit(b).alias("current_state"), s.cast("bigint").alias("secs"))
                         for j, (a, b, s) in enumerate(steps)])
        rows = self._served().select(
            key, "unit_id", "channel", "sos_breach", "placed_at", F.explode(step).alias("s")
        ).select(
            (key * 10 + F.col("s.j")).alias("status_event_id"), key, "unit_id", "s.prior_state",
            "s.current_state", (F.col("placed_at") + seconds(F.col("s.secs"))).alias("event_timestamp"),
            F.col("s.secs").alias("elapsed_seconds_in_prior_state"),
            F.when(F.col("channel") == "carryout", 720).otherwise(1800).cast("bigint").alias("sos_target_seconds"),
            (F.col("sos_breach") & (F.col("s.current_state") == "ready")).alias("is_sos_breach"),
            "placed_at", F.lit("synth").alias("source"))
        return self._head(rows, "status_event", "status_event_id", "placed_at").drop("placed_at")

    def _ev_delivery_order(self):
        key = F.col("guest_order_id")
        est = F.lit(1800) + key % 900
        rows = self._orders.filter(F.col("channel").like("%delivery")).select(
            key.alias("delivery_order_id"), key, "unit_id",
            F.when(F.col("channel") == "3pd_delivery", F.concat(F.lit("P"), key.cast("string")))
            .alias("platform_order_reference"),
            est.alias("estimated_delivery_seconds"),
            (est - 300 + (key * 7) % 1201).alias("actual_delivery_seconds"),
            F.lit("delivered").alias("delivery_status"), "placed_at", F.lit("synth").alias("source"))
        return self._head(rows, "delivery_order", "delivery_order_id", "placed_at").drop("placed_at")

    # ---- inventory domain
    @staticmethod
    def _sku() -> Column:
        return F.concat(F.lit("sku_"), (F.col("l_partkey") % 9).cast("string"))

    def _ev_on_hand_balance(self):
        rows = self._lines.filter(F.col("l_returnflag") == "A").select(
            self._line_id("ohb").alias("on_hand_balance_id"), "unit_id", self._sku().alias("stock_sku"),
            F.col("l_quantity").alias("quantity_on_hand"),
            (F.col("l_quantity") / F.lit(10.0)).alias("quantity_reserved"),
            F.lit(20.0).alias("par_level"), F.col("l_shipdate").alias("snapshot_at"))
        return self._head(rows, "on_hand_balance", "on_hand_balance_id", "snapshot_at")

    def _ev_waste_log(self):
        rows = self._lines.filter(F.col("l_returnflag") == "R").select(
            self._line_id("wl").alias("waste_log_id"), "unit_id", self._sku().alias("stock_sku"),
            (F.col("l_quantity") * 4 / F.lit(100.0)).alias("waste_quantity"),
            pick(WASTE_CATEGORIES, F.col("l_partkey") % 5).alias("waste_category"),
            (F.col("l_quantity") / F.lit(10.0)).alias("waste_cost"), self._logged_at().alias("logged_at"))
        return self._head(rows, "waste_log", "waste_log_id", "logged_at")

    def _ev_receiving_order(self):
        rows = self._lines.filter(F.col("l_returnflag") == "N").select(
            self._line_id("rcv").alias("receiving_order_id"), "unit_id", self._sku().alias("stock_sku"),
            F.col("l_quantity").alias("received_quantity"),
            F.to_date("l_shipdate").cast("string").alias("delivery_date"),
            F.when(F.col("l_partkey") % 50 == 0, "fail").otherwise("pass").alias("quality_inspection_result"),
            (F.col("l_suppkey") % 25 != 0).alias("temperature_check_pass"), "l_shipdate")
        return self._head(rows, "receiving_order", "receiving_order_id", "l_shipdate").drop("l_shipdate")

    def _ev_replenishment_order(self):
        rows = self._lines.filter((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 5)).select(
            self._line_id("rep").alias("replenishment_order_id"), "unit_id", self._sku().alias("stock_sku"),
            F.lit("auto_par").alias("order_type"), (F.lit(20.0) - F.col("l_quantity")).alias("order_quantity"),
            F.when(F.col("l_partkey") % 3 == 0, "open").otherwise("submitted").alias("order_status"),
            F.col("l_shipdate").alias("ordered_at"))
        return self._head(rows, "replenishment_order", "replenishment_order_id", "ordered_at")

    # ---- guest, loyalty, workforce domains
    def _ev_guest_profile(self):
        return profile_events(self.raw("events"))

    @cached_property
    def _member_orders(self) -> DataFrame:
        """Paying member orders with the member's tier."""
        rows = self._orders.filter(F.col("member_id").isNotNull() & (F.col("total_amount") > 0))
        return rows.withColumn("tier", tier_for_spend((F.col("member_id") * 47) % 4000))

    @staticmethod
    def _redeemed() -> Column:
        return pick((100, 200, 500), F.col("guest_order_id") % 3).cast("bigint")

    def _ev_loyalty_transaction(self):
        o, m = F.col("guest_order_id"), F.col("member_id")
        earn = self._member_orders.select(
            make_id("lt_earn", o, m).alias("loyalty_transaction_id"), m, o, "unit_id",
            F.lit("earn").alias("transaction_type"),
            points_earned(F.col("total_amount"), F.col("tier")).alias("points_delta"),
            F.col("placed_at").alias("transaction_at"), "tier")
        redeem = self._member_orders.filter(o % 13 == 0).select(
            make_id("lt_redeem", o, m).alias("loyalty_transaction_id"), m, o, "unit_id",
            F.lit("redeem").alias("transaction_type"), (-self._redeemed()).alias("points_delta"),
            F.col("placed_at").alias("transaction_at"), "tier")
        return self._head(earn.unionByName(redeem), "loyalty_transaction", "loyalty_transaction_id",
                          "transaction_at")

    def _ev_reward_redemption(self):
        o, m = F.col("guest_order_id"), F.col("member_id")
        rows = self._member_orders.filter(o % 13 == 0).select(
            make_id("rr", o, m).alias("reward_redemption_id"), m, o, "unit_id",
            self._redeemed().alias("points_redeemed"), (self._redeemed() / F.lit(100.0)).alias("reward_value"),
            F.col("placed_at").alias("redeemed_at"))
        return self._head(rows, "reward_redemption", "reward_redemption_id", "redeemed_at")

    def _ev_shift(self):
        rows = self.raw("events").select(
            F.col("event_id").alias("shift_id"), (F.col("user_id") % 25).alias("unit_id"),
            F.col("user_id").alias("employee_id"), pick(SHIFT_LABELS, F.col("event_id") % 4).alias("shift_label"),
            F.col("ts").alias("shift_start"), (F.col("ts") + hours(F.lit(8))).alias("shift_end"),
            F.when(F.col("event_id") % 25 == 0, "no_show").otherwise("completed").alias("status"),
            F.to_date("ts").cast("string").alias("date"))
        return self._head(rows, "shift", "shift_id", "shift_start")

    def _ev_time_punch(self):
        worked = cents("value")
        rows = self.raw("events").select(
            F.col("event_id").alias("time_punch_id"), F.col("user_id").alias("employee_id"),
            (F.col("user_id") % 25).alias("unit_id"), F.col("ts").alias("punch_in"),
            (F.col("ts") + seconds(F.floor(worked * 36 / F.lit(10)))).alias("punch_out"),
            (worked / F.lit(1000.0)).alias("hours_worked"))
        return self._head(rows, "time_punch", "time_punch_id", "punch_in")

    def envelope(self, table: str) -> DataFrame:
        """The whole multiplexed staging table with its declared columns."""
        schema = schemas.ENVELOPES[table]
        out = None
        for event_type, home in schemas.ROUTES.items():
            if home != table or not hasattr(self, f"_ev_{event_type}"):  # a type without supplied rows
                continue
            rows = self.events_of(event_type)
            have = set(rows.columns)
            rows = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                                 for f in schema.fields])
            out = rows if out is None else out.unionByName(rows)
        return out

    # ---- silver tables, by running the engine on the matching branch
    def _silver(self, name: str, owner: bool = False) -> DataFrame:
        rows = silver.typed(self.events_of(name), name, F.col("event_ts"))
        return silver.with_owner(rows, self.unit) if owner else rows

    guest_order = cached_property(lambda self: self._silver("guest_order", True))
    order_item = cached_property(lambda self: self._silver("order_item"))
    payment = cached_property(lambda self: self._silver("payment"))
    status_event = cached_property(lambda self: self._silver("status_event"))
    delivery_order = cached_property(lambda self: self._silver("delivery_order"))
    on_hand_balance = cached_property(lambda self: self._silver("on_hand_balance"))
    waste_log = cached_property(lambda self: self._silver("waste_log", True))
    receiving_order = cached_property(lambda self: self._silver("receiving_order"))
    replenishment_order = cached_property(lambda self: self._silver("replenishment_order"))
    loyalty_transaction = cached_property(lambda self: self._silver("loyalty_transaction", True))
    reward_redemption = cached_property(lambda self: self._silver("reward_redemption"))
    shift = cached_property(lambda self: self._silver("shift"))
    time_punch = cached_property(lambda self: self._silver("time_punch", True))
    guest_profile = cached_property(lambda self: silver.guest_profile(self._ev_guest_profile(), self.unit))
    digital_account = cached_property(
        lambda self: silver.digital_account(self._ev_guest_profile(), F.col("event_ts")))

    # ---- weather and local events: every order carries one outside observation
    @cached_property
    def weather_feed(self) -> DataFrame:
        """Raw observations: one per order, of the metro and day it was placed in."""
        k = F.col("guest_order_id")
        obs = self._orders.filter(F.col("unit_id").isNotNull()).select(
            k.alias("observation_id"), "unit_id", F.to_date("placed_at").alias("forecast_date"),
            (k % 100).cast("int").alias("weather_code"), (F.lit(40.0) + k % 65).alias("high_temp_f"),
            (F.lit(10.0) + k % 30).alias("low_temp_f"), ((k % 40) / F.lit(10.0)).alias("precipitation_inches"))
        return obs.join(self.unit.select("unit_id", "metro_area", "state"), "unit_id")

    @cached_property
    def alert_feed(self) -> DataFrame:
        """Raw alerts: every 10th order reports one for its state."""
        k = F.col("guest_order_id")
        day = F.to_date("placed_at")
        kinds = ("Heat Advisory", "Winter Storm Warning", "Flood Watch", "Special Statement")
        rows = self._orders.filter((k % 10 == 0) & F.col("unit_id").isNotNull()).select(
            k.alias("alert_id"), "unit_id", pick(kinds, (k / 10).cast("bigint") % 4).alias("event"),
            F.concat(day.cast("string"), F.lit("T06:00:00Z")).alias("onset"),
            F.when(k % 9 != 0, F.concat(F.date_add(day, (k % 4).cast("int")).cast("string"), F.lit("T18:00:00Z")))
            .alias("expires"))
        return rows.join(self.unit.select("unit_id", "state"), "unit_id").drop("unit_id")

    @cached_property
    def happening_feed(self) -> DataFrame:
        """Raw local events: every 7th order reports one from one of three sources."""
        k = F.col("guest_order_id")
        rows = self._orders.filter((k % 7 == 0) & F.col("unit_id").isNotNull()).select(
            k.alias("report_id"), "unit_id", F.to_date("placed_at").cast("string").alias("event_date"),
            F.concat(F.lit("Event "), ((k / 7).cast("bigint") % 6).cast("string")).alias("event_name"),
            pick(("nager", "ticketmaster", "seatgeek"), (k / 7).cast("bigint") % 3).alias("source"),
            F.concat(F.lit("Venue "), (k % 11).cast("string")).alias("venue"),
            (k % 9 + 1).alias("crowd"))
        return rows.join(self.unit.select("unit_id", "metro_area", "state"), "unit_id").drop("unit_id")

    @cached_property
    def daily_weather(self) -> DataFrame:
        """Parsed and overlaid rows before the upsert: newest observation per metro and day."""
        obs = silver.latest(self.weather_feed.drop("unit_id"), ["metro_area", "forecast_date"], "observation_id")
        return enrich.weather_rows(obs, self.today)

    @cached_property
    def weather_conditions(self) -> DataFrame:
        alerts = enrich.classified_alerts(self.alert_feed)
        return enrich.with_multipliers(enrich.apply_alerts(self.daily_weather, alerts, self.unit))

    @cached_property
    def local_events(self) -> DataFrame:
        return enrich.merge_event_sources(payload_feeds.event_rows(self.happening_feed))

    @cached_property
    def demand_risk_forecast(self) -> DataFrame:
        return views.demand_risk_forecast(self.unit, self.weather_conditions, self.local_events, self.today)

    # ---- telemetry
    @cached_property
    def otel_logs(self) -> DataFrame:
        return telemetry_logs(self.raw("events"))

    @cached_property
    def otel_spans(self) -> DataFrame:
        return telemetry_spans(self.raw("events"))

    # ---- features
    @cached_property
    def customer_features(self) -> DataFrame:
        return features.customer_features(
            self.guest_order, self.order_item, features.latest_tier(self.loyalty_transaction),
            self.menu_item, self.order_clock)

    @cached_property
    def item_popularity(self) -> DataFrame:
        return features.item_popularity(self.order_item)

    @cached_property
    def feature_tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Customer, store and popularity features as written tables.

        The recommender reads each of them several times, so they are stored
        once, as in production, instead of being recomputed per use.
        """
        return self.known_customers, sinks.settled(self.store_features, "store_features"), self.known_popularity

    # Each stored on its own, for jobs that need only some of them.
    @cached_property
    def known_customers(self) -> DataFrame:
        return sinks.settled(self.customer_features, "customer_features")

    @cached_property
    def known_popularity(self) -> DataFrame:
        return sinks.settled(self.item_popularity, "item_popularity")

    @cached_property
    def known_store_values(self) -> DataFrame:
        return sinks.lookup(features.store_values(self.guest_order, self.unit), "store_values")

    @cached_property
    def store_features(self) -> DataFrame:
        return features.store_features(self.guest_order, self.order_item, self.unit, self.menu_item)


def profile_events(events: DataFrame) -> DataFrame:
    """Profile change feed from user events; an error event carries no contact data."""
    u, kind = F.col("user_id"), F.col("event_type")
    lost = kind == "error"
    status = F.when(kind == "view", "inactive").when(lost, "suspended").otherwise("active")
    return events.select(
        F.lit("guest_profile").alias("event_type"), "event_id", (u % 25).alias("unit_id"),
        F.col("ts").alias("event_ts"), u.alias("guest_profile_id"), (u * 10 + 1).alias("digital_account_id"),
        F.concat(F.lit("First"), u.cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), u.cast("string")).alias("last_name"),
        F.when(~lost, F.concat(F.lit("user"), u.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(~lost, F.concat(F.lit("(555) 010-"), F.lpad((u % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.lpad((u % 100000).cast("string"), 5, "0").alias("zip_code"),
        F.to_date("ts").cast("string").alias("created_date"), status.alias("account_status"))


def _attributes(**cols: Column) -> Column:
    """Map of the non-NULL entries."""
    entries = F.array(*[F.struct(F.lit(k.replace("__", ".")).alias("key"), v.alias("value"))
                        for k, v in cols.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def telemetry_logs(events: DataFrame) -> DataFrame:
    """Purchase events as checkout log records."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    amount = F.when(e % 19 == 0, "n/a").when(e % 17 == 0, "0").otherwise(text(F.col("value")))
    who = (F.when(e % 23 == 0, "fee-test-").when(e % 29 == 0, "c2-verify-").otherwise("user-"))
    return events.filter(F.col("event_type") == "purchase").select(
        text(e).alias("trace_id"), (F.unix_micros("ts") * 1000).alias("time_unix_nano"),
        _attributes(
            app__order__id=F.concat(F.lit("web-"), text(e - e % 5)),
            app__order__amount=amount,
            app__order__member_id=F.when(u % 3 != 0, F.concat(F.lit(" "), text(u))),
            app__order__items__count=text(e % 4 + 1),
            app__shipping__tracking__id=F.concat(F.lit("TRK-"), text(e)),
            user__id=F.concat(who, text(u)),
        ).alias("attributes"))


STAGES = ("Prep", "Bake", "Quality Check", "Out For Delivery", "Delivered")


def telemetry_spans(events: DataFrame) -> DataFrame:
    """Order-tracker and stage spans of the purchase events."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    paid = events.filter(F.col("event_type") == "purchase")
    nano = F.unix_micros("ts") * 1000
    sku = lambda i: F.concat(F.lit('"'), text((e + i * 7) % 80), F.lit(" x"), text((e + i) % 4), F.lit('"'))
    order = paid.filter(e % 11 != 0).select(
        text(e).alias("trace_id"), F.lit("order-tracker received order").alias("name"),
        nano.alias("start_time_unix_nano"),
        _attributes(
            order__store_id=F.concat(F.lit("store-"), text(u % 40)),
            order__channel=F.when(e % 3 == 0, "delivery").when(e % 3 == 1, "carryout").otherwise("kiosk"),
            order__skus=F.when(e % 13 == 0, "garbage").otherwise(
                F.concat(F.lit("["), sku(0), F.lit(","), sku(1), F.lit("]"))),
            order__prep_seconds=text(600 + e % 2400),
            sos__target_seconds=F.when(e % 7 != 0, "1500"),
            order__total_quantity=text(e % 4 + (e + 1) % 4),
            order__location__state=F.concat(F.lit("NATION_"), text(u % 30)),
            order__location__city=F.concat(F.lit("City "), text(u % 30)),
            order__location__zip=F.lpad(text(u), 5, "0"),
        ).alias("attributes"))
    stage = paid.filter(e % 4 != 0).select(
        e, nano.alias("nano"),
        F.posexplode(F.slice(F.array(*[F.lit(s) for s in STAGES]), F.lit(1), (e % 6).cast("int"))).alias("i", "stage"),
    ).select(
        text(e).alias("trace_id"), F.concat(F.lit("stage: "), F.col("stage")).alias("name"),
        (F.col("nano") + (F.col("i") + 1) * 60_000_000_000).alias("start_time_unix_nano"),
        F.create_map().cast("map<string,string>").alias("attributes"))
    return order.unionByName(stage)
