"""Tier and points rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lifetime-spend floor and points multiplier of each tier.
TIERS = (("bronze", 0, 1.0), ("silver", 500, 1.25), ("gold", 1500, 1.5), ("platinum", 3500, 2.0))

# Multiplier table of the governance layer (a different table).
GOVERNANCE_MULTIPLIERS = {"bronze": 1.0, "silver": 1.5, "gold": 2.0, "elite": 3.0}


def tier_for_spend(spend: Column) -> Column:
    """Highest tier whose floor the spend reaches; bronze otherwise."""
    out = F.lit("bronze")
    for name, floor, _ in TIERS:
        out = F.when(spend >= floor, F.lit(name)).otherwise(out)
    return out


def points_multiplier(tier: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, _, mult in TIERS:
        out = F.when(tier == name, F.lit(mult)).otherwise(out)
    return out


def points_earned(total: Column, tier: Column) -> Column:
    """Whole points: ten per currency unit times the tier multiplier, cut down.

    Cents and quarter-multipliers are integers, so no product is lost to binary
    rounding just below a whole point.
    """
    cents = F.floor(total * 100 + F.lit(0.5))
    quarters = (points_multiplier(tier) * 4).cast("bigint")
    return F.floor(cents * quarters / F.lit(40)).cast("bigint")


def tier_to_multiplier(tier: Column) -> Column:
    """Governance multiplier; unknown and NULL tiers are 1.0."""
    out = F.lit(1.0)
    for name, mult in GOVERNANCE_MULTIPLIERS.items():
        out = F.when(tier == name, F.lit(mult)).otherwise(out)
    return out
