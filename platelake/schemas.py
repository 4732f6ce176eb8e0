"""Declared table schemas: envelopes, silver keys, expectations."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
          "timestamp": T.TimestampType()}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# Columns and types of the envelopes.
ORDER_EVENTS = _struct(
    event_type="string", event_id="bigint", unit_id="bigint", event_ts="timestamp", guest_order_id="bigint",
    order_item_id="bigint", payment_id="bigint", status_event_id="bigint", delivery_order_id="bigint",
    channel="string", order_type="string", order_status="string", profile_id="bigint", member_id="bigint",
    subtotal="double", discount_amount="double", tax_amount="double", total_amount="double", placed_at="timestamp",
    ready_at="timestamp", fulfilled_at="timestamp", cancelled_at="timestamp", financial_period_id="bigint",
    sos_breach="boolean", menu_item_id="bigint", quantity="bigint", unit_price="double",
    line_gross_amount="double", line_net_amount="double", line_discount_amount="double", item_status="string",
    waste_flag="boolean", tender_type="string", amount="double", settlement_date="string", paid_at="timestamp",
    prior_state="string", current_state="string", event_timestamp="timestamp",
    elapsed_seconds_in_prior_state="bigint", sos_target_seconds="bigint", is_sos_breach="boolean",
    platform_order_reference="string", estimated_delivery_seconds="bigint", actual_delivery_seconds="bigint",
    delivery_status="string", source="string")

INVENTORY_EVENTS = _struct(
    event_type="string", event_id="bigint", unit_id="bigint", event_ts="timestamp", on_hand_balance_id="bigint",
    waste_log_id="bigint", receiving_order_id="bigint", replenishment_order_id="bigint", stock_sku="string",
    quantity_on_hand="double", quantity_reserved="double", par_level="double", snapshot_at="timestamp",
    waste_quantity="double", waste_category="string", waste_cost="double", logged_at="timestamp",
    received_quantity="double", delivery_date="string", quality_inspection_result="string",
    temperature_check_pass="boolean", order_type="string", order_quantity="double", order_status="string",
    ordered_at="timestamp")

GUEST_EVENTS = _struct(
    event_type="string", event_id="bigint", unit_id="bigint", event_ts="timestamp", guest_profile_id="bigint",
    digital_account_id="bigint", first_name="string", last_name="string", email="string", phone="string",
    zip_code="string", created_date="string", account_status="string")

LOYALTY_EVENTS = _struct(
    event_type="string", event_id="bigint", unit_id="bigint", event_ts="timestamp",
    loyalty_transaction_id="bigint", reward_redemption_id="bigint", member_id="bigint", guest_order_id="bigint",
    transaction_type="string", points_delta="bigint", transaction_at="timestamp", tier="string",
    points_redeemed="bigint", reward_value="double", redeemed_at="timestamp")

WORKFORCE_EVENTS = _struct(
    event_type="string", event_id="bigint", unit_id="bigint", event_ts="timestamp", shift_id="bigint",
    time_punch_id="bigint", employee_id="bigint", shift_label="string", shift_start="timestamp",
    shift_end="timestamp", status="string", date="string", punch_in="timestamp", punch_out="timestamp",
    hours_worked="double")

ENVELOPES = {
    "order_events": ORDER_EVENTS,
    "inventory_events": INVENTORY_EVENTS,
    "guest_events": GUEST_EVENTS,
    "loyalty_events": LOYALTY_EVENTS,
    "workforce_events": WORKFORCE_EVENTS,
}

# Which envelope table carries which event type.
ROUTES = {
    "guest_order": "order_events", "order_item": "order_events", "payment": "order_events",
    "status_event": "order_events", "delivery_order": "order_events",
    "on_hand_balance": "inventory_events", "waste_log": "inventory_events",
    "receiving_order": "inventory_events", "replenishment_order": "inventory_events",
    "guest_profile": "guest_events", "digital_account": "guest_events",
    "loyalty_transaction": "loyalty_events", "reward_redemption": "loyalty_events",
    "shift": "workforce_events", "time_punch": "workforce_events",
}

PRIMARY_KEYS = {
    "guest_order": "guest_order_id", "order_item": "order_item_id", "payment": "payment_id",
    "status_event": "status_event_id", "delivery_order": "delivery_order_id",
    "on_hand_balance": "on_hand_balance_id", "waste_log": "waste_log_id",
    "receiving_order": "receiving_order_id", "replenishment_order": "replenishment_order_id",
    "guest_profile": "guest_profile_id", "digital_account": "digital_account_id",
    "loyalty_transaction": "loyalty_transaction_id", "reward_redemption": "reward_redemption_id",
    "shift": "shift_id", "time_punch": "time_punch_id",
}

# Tables that a table's rows refer to, by the primary key of the parent.
PARENTS = {
    "order_item": ("guest_order",), "payment": ("guest_order",), "status_event": ("guest_order",),
    "delivery_order": ("guest_order",), "loyalty_transaction": ("guest_order",), "digital_account": ("guest_profile",),
}

# Column classes that drive masking; the raw guest envelope carries those of the profile.
_GUEST_TAGS = {
    "email": "class.email_address", "phone": "class.phone_number",
    "first_name": "class.name", "last_name": "class.name", "zip_code": "class.zip_code",
}

COLUMN_TAGS = {
    "guest_events": _GUEST_TAGS,
    "guest_profile": _GUEST_TAGS,
    "guest_order": {c: "financial" for c in
                    ("subtotal", "discount_amount", "tax_amount", "total_amount")},
    "waste_log": {"waste_cost": "financial", "stock_sku": "supply_chain"},
    "on_hand_balance": {"stock_sku": "supply_chain"},
}
