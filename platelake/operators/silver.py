"""Envelope -> typed tables.

Each function takes an envelope DataFrame, batch or streaming, and returns the
typed rows of one event type.  ``ingested_at`` stamps ``created_at``; it
defaults to the wall clock and is passed explicitly wherever results must be
repeatable.  The unit dimension is joined without a hint: its size is known to
the planner, which broadcasts it below the session threshold and shuffles it
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.operators.quality import expect_or_drop

# Columns and types of each table.
COLUMNS = {
    "guest_order": {
        "guest_order_id": "bigint", "unit_id": "bigint", "channel": "string", "order_type": "string",
        "order_status": "string", "profile_id": "bigint", "member_id": "bigint", "subtotal": "double",
        "discount_amount": "double", "tax_amount": "double", "total_amount": "double", "placed_at": "timestamp",
        "ready_at": "timestamp", "fulfilled_at": "timestamp", "cancelled_at": "timestamp",
        "financial_period_id": "bigint", "sos_breach": "boolean",
    },
    "order_item": {
        "order_item_id": "bigint", "guest_order_id": "bigint", "unit_id": "bigint", "menu_item_id": "bigint",
        "quantity": "int", "unit_price": "double", "line_gross_amount": "double", "line_net_amount": "double",
        "line_discount_amount": "double", "item_status": "string", "waste_flag": "boolean",
        "placed_at": "timestamp",
    },
    "payment": {
        "payment_id": "bigint", "guest_order_id": "bigint", "unit_id": "bigint", "tender_type": "string",
        "amount": "double", "settlement_date": "string", "paid_at": "timestamp",
    },
    "status_event": {
        "status_event_id": "bigint", "guest_order_id": "bigint", "unit_id": "bigint", "prior_state": "string",
        "current_state": "string", "event_timestamp": "timestamp", "elapsed_seconds_in_prior_state": "int",
        "sos_target_seconds": "int", "is_sos_breach": "boolean",
    },
    "delivery_order": {
        "delivery_order_id": "bigint", "guest_order_id": "bigint", "unit_id": "bigint",
        "platform_order_reference": "string", "estimated_delivery_seconds": "int",
        "actual_delivery_seconds": "int", "delivery_status": "string",
    },
    "on_hand_balance": {
        "on_hand_balance_id": "bigint", "unit_id": "bigint", "stock_sku": "string", "quantity_on_hand": "double",
        "quantity_reserved": "double", "par_level": "double", "snapshot_at": "timestamp",
    },
    "waste_log": {
        "waste_log_id": "bigint", "unit_id": "bigint", "stock_sku": "string", "waste_quantity": "double",
        "waste_category": "string", "waste_cost": "double", "logged_at": "timestamp",
    },
    "receiving_order": {
        "receiving_order_id": "bigint", "unit_id": "bigint", "stock_sku": "string", "received_quantity": "double",
        "delivery_date": "string", "quality_inspection_result": "string", "temperature_check_pass": "boolean",
    },
    "replenishment_order": {
        "replenishment_order_id": "bigint", "unit_id": "bigint", "stock_sku": "string", "order_type": "string",
        "order_quantity": "double", "order_status": "string", "ordered_at": "timestamp",
    },
    "guest_profile": {
        "guest_profile_id": "bigint", "unit_id": "bigint", "first_name": "string", "last_name": "string",
        "email": "string", "phone": "string", "zip_code": "string", "created_date": "string",
        "account_status": "string",
    },
    "digital_account": {
        "digital_account_id": "bigint", "guest_profile_id": "bigint", "account_status": "string",
        "created_date": "string",
    },
    "loyalty_transaction": {
        "loyalty_transaction_id": "bigint", "member_id": "bigint", "guest_order_id": "bigint", "unit_id": "bigint",
        "transaction_type": "string", "points_delta": "int", "transaction_at": "timestamp", "tier": "string",
    },
    "reward_redemption": {
        "reward_redemption_id": "bigint", "member_id": "bigint", "guest_order_id": "bigint", "unit_id": "bigint",
        "points_redeemed": "int", "reward_value": "double", "redeemed_at": "timestamp",
    },
    "shift": {
        "shift_id": "bigint", "unit_id": "bigint", "employee_id": "bigint", "shift_label": "string",
        "shift_start": "timestamp", "shift_end": "timestamp", "status": "string", "date": "string",
    },
    "time_punch": {
        "time_punch_id": "bigint", "employee_id": "bigint", "unit_id": "bigint", "punch_in": "timestamp",
        "punch_out": "timestamp", "hours_worked": "double",
    },
}

EXPECTATIONS = {
    "guest_order": {"valid_total": "total_amount >= 0", "valid_unit": "unit_id IS NOT NULL"},
    "order_item": {"positive_price": "unit_price > 0"},
    "on_hand_balance": {"non_negative_stock": "quantity_on_hand >= 0"},
}


def typed(events: DataFrame, table: str, ingested_at: Column | str | None = None,
          event_type: str | None = None) -> DataFrame:
    """Rows of one event type, cast to the table's columns, expectations applied."""
    cols = [F.col(name).cast(kind).alias(name) for name, kind in COLUMNS[table].items()]
    stamp = F.current_timestamp() if ingested_at is None else ingested_at
    stamp = F.col(stamp) if isinstance(stamp, str) else stamp
    rows = events.filter(F.col("event_type") == (event_type or table)).select(
        *cols, stamp.alias("created_at"))
    return expect_or_drop(rows, EXPECTATIONS.get(table, {}))


def with_owner(df: DataFrame, unit: DataFrame) -> DataFrame:
    """Add franchisee and region of the unit; rows of unknown units keep NULLs."""
    return df.join(unit.select("unit_id", "franchisee_id", "region_id"), "unit_id", "left")


def guest_order(events, unit, ingested_at=None):
    return with_owner(typed(events, "guest_order", ingested_at), unit)


def order_item(events, ingested_at=None):
    return typed(events, "order_item", ingested_at)


def payment(events, ingested_at=None):
    return typed(events, "payment", ingested_at)


def status_event(events, ingested_at=None):
    return typed(events, "status_event", ingested_at)


def delivery_order(events, ingested_at=None):
    return typed(events, "delivery_order", ingested_at)


def on_hand_balance(events, ingested_at=None):
    return typed(events, "on_hand_balance", ingested_at)


def waste_log(events, unit, ingested_at=None):
    return with_owner(typed(events, "waste_log", ingested_at), unit)


def receiving_order(events, ingested_at=None):
    return typed(events, "receiving_order", ingested_at)


def replenishment_order(events, ingested_at=None):
    return typed(events, "replenishment_order", ingested_at)


def guest_profile_changes(events, unit):
    """Change feed of profiles; the event time is the version."""
    return with_owner(typed(events, "guest_profile", F.col("event_ts")), unit)


def digital_account(events, ingested_at=None, distinct_accounts: bool = False):
    """One row per profile change, or the newest per account on request."""
    rows = typed(events, "digital_account", ingested_at, "guest_profile")
    return latest(rows, ["digital_account_id"], "created_at") if distinct_accounts else rows


def loyalty_transaction(events, unit, ingested_at=None):
    return with_owner(typed(events, "loyalty_transaction", ingested_at), unit)


def reward_redemption(events, ingested_at=None):
    return typed(events, "reward_redemption", ingested_at)


def shift(events, ingested_at=None):
    return typed(events, "shift", ingested_at)


def time_punch(events, unit, ingested_at=None):
    return with_owner(typed(events, "time_punch", ingested_at), unit)


def latest(df: DataFrame, keys: list[str], *version: str, ignore_nulls: bool = False) -> DataFrame:
    """Newest row per key.

    ``max_by`` combines before the shuffle, so one hot key never lands whole in
    a single task as it would with a window.  NULLs in the newest row win
    unless ``ignore_nulls`` asks for the newest non-NULL value per column.
    """
    order = F.struct(*[F.col(v) for v in version])
    rest = [c for c in df.columns if c not in keys]
    if ignore_nulls:
        aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in rest]
        return df.groupBy(*keys).agg(*aggs).select(*df.columns)
    row = F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("row")
    return df.groupBy(*keys).agg(row).select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c)
                                               for c in df.columns])


def guest_profile(events, unit, ignore_nulls: bool = False):
    """Current state per profile.  A change without contact data clears it."""
    return latest(guest_profile_changes(events, unit), ["guest_profile_id"], "created_at",
                  ignore_nulls=ignore_nulls)
