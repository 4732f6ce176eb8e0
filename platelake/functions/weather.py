"""Weather and event classification and demand multipliers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platelake.functions.numeric import clamp

# WMO code ranges (inclusive) and their condition.
WMO_RANGES = (
    (51, 57, "rain"), (61, 63, "rain"), (64, 67, "heavy_rain"),
    (71, 73, "snow"), (74, 77, "heavy_snow"), (80, 82, "rain"),
    (83, 84, "heavy_rain"), (85, 86, "heavy_snow"), (95, 99, "storm"),
)

# Condition -> (demand multiplier, shift to delivery).
CONDITIONS = {
    "clear": (1.00, 0.00), "rain": (0.92, 0.08), "heavy_rain": (0.85, 0.15),
    "snow": (0.88, 0.10), "heavy_snow": (0.70, 0.20), "extreme_heat": (0.90, 0.12),
    "extreme_cold": (0.82, 0.15), "storm": (0.60, 0.25),
}

# Alert level -> demand change, and severity order.
ALERTS = {"advisory": -0.05, "watch": -0.10, "warning": -0.20}
SEVERITY = {"advisory": 1, "watch": 2, "warning": 3}

# Event category -> demand multiplier.
EVENTS = {
    "major_sports": 1.60, "concert": 1.30, "festival": 1.20,
    "civic_holiday": 0.85, "national_holiday": 0.75,
}

# Bounds of any demand multiplier.
LOW, HIGH = 0.30, 2.50


def lookup(key: Column, table: dict, default) -> Column:
    """CASE chain over a handful of literals; cheaper than any join."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def wmo_condition(code: Column) -> Column:
    out = F.lit("clear")
    for low, high, name in WMO_RANGES:
        out = F.when(code.between(low, high), F.lit(name)).otherwise(out)
    return out


def temperature_override(condition: Column, high: Column, low: Column) -> Column:
    return (
        F.when(high > 100, F.lit("extreme_heat"))
        .when(low < 15, F.lit("extreme_cold"))
        .otherwise(condition)
    )


def classify_alert(event: Column) -> Column:
    """'warning', 'watch' or 'advisory' by substring, strongest first; else NULL."""
    text = F.lower(event)
    return (
        F.when(text.contains("warning"), "warning")
        .when(text.contains("watch"), "watch")
        .when(text.contains("advisory"), "advisory")
    )


def demand_multiplier(condition: Column, alert: Column) -> Column:
    base = lookup(condition, {k: v[0] for k, v in CONDITIONS.items()}, 1.0)
    delta = F.coalesce(lookup(alert, ALERTS, 0.0), F.lit(0.0))
    return F.round(clamp(base + delta, LOW, HIGH), 4)


def delivery_shift(condition: Column) -> Column:
    return lookup(condition, {k: v[1] for k, v in CONDITIONS.items()}, 0.0)


def event_multiplier(category: Column) -> Column:
    return lookup(category, EVENTS, 1.0)


def combine(weather: Column, event: Column) -> Column:
    """Unrounded, clamped product; absent factors count as 1."""
    return clamp(F.coalesce(weather, F.lit(1.0)) * F.coalesce(event, F.lit(1.0)), LOW, HIGH)


def risk_level(combined: Column) -> Column:
    return (
        F.when(combined < 0.8, "demand_risk").when(combined > 1.4, "capacity_risk").otherwise("normal")
    )
