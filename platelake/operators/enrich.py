"""Weather, alerts and local events -> demand signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.functions import weather as wx
from platelake.operators.silver import latest


def metro_centroids(unit: DataFrame) -> DataFrame:
    return unit.groupBy("metro_area", "state").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def weather_rows(obs: DataFrame, today: Column) -> DataFrame:
    """Typed daily weather from code and temperatures; missing numbers are 0."""
    high = F.coalesce("high_temp_f", F.lit(0.0))
    low = F.coalesce("low_temp_f", F.lit(0.0))
    return obs.select(
        "metro_area", "forecast_date",
        F.when(F.col("forecast_date") < today, "historical").otherwise("forecast").alias("observation_type"),
        high.alias("high_temp_f"), low.alias("low_temp_f"),
        F.coalesce("precipitation_inches", F.lit(0.0)).alias("precipitation_inches"),
        wx.temperature_override(wx.wmo_condition(F.col("weather_code")), high, low).alias("weather_condition"),
    )


def classified_alerts(alerts: DataFrame) -> DataFrame:
    """Keep alerts whose text names a level; cut the bounds to their date."""
    day = lambda c: F.try_to_date(F.substring(c, 1, 10))
    return alerts.select(
        "state", "event", wx.classify_alert(F.col("event")).alias("alert_level"),
        day("onset").alias("onset_date"), day("expires").alias("expires_date"),
    ).filter(F.col("alert_level").isNotNull())


def apply_alerts(weather: DataFrame, alerts: DataFrame, unit: DataFrame, first: Column | None = None,
                 last: Column | None = None) -> DataFrame:
    """Strongest alert in force per metro and day.

    Alerts are only spread over the days from ``first`` to ``last``; by default
    those of the weather rows, which costs a pass over them.

    An alert holds in every metro of its state from onset to expiry.  Without an
    expiry it never holds; without an onset it holds on every day up to expiry.
    Dated alerts become one severity per metro and day before the join, and open
    ones one last day per metro and severity, so no date range is ever compared
    pairwise.
    """
    metros = unit.select("metro_area", "state").distinct()
    rank = wx.lookup(F.col("alert_level"), wx.SEVERITY, 0)
    local = alerts.filter(F.col("expires_date").isNotNull()).join(metros, "state").select(
        "metro_area", rank.alias("severity"), "onset_date", "expires_date")
    first = weather.agg(F.min("forecast_date")).scalar() if first is None else first
    last = weather.agg(F.max("forecast_date")).scalar() if last is None else last
    start, end = F.greatest("onset_date", first), F.least("expires_date", last)
    dated = (
        local.filter(F.col("onset_date").isNotNull() & (start <= end))
        .groupBy("metro_area", "onset_date", "expires_date").agg(F.max("severity").alias("severity"))
        .select("metro_area", "severity", F.explode(F.sequence(start, end)).alias("forecast_date"))
        .groupBy("metro_area", "forecast_date").agg(F.max("severity").alias("dated"))
    )
    until = [F.max(F.when(F.col("severity") == s, F.col("expires_date"))).alias(f"until_{s}") for s in (1, 2, 3)]
    open_start = local.filter(F.col("onset_date").isNull()).groupBy("metro_area").agg(*until)
    held = F.lit(0)
    for s in (1, 2, 3):
        held = F.when(F.col("forecast_date") <= F.col(f"until_{s}"), F.lit(s)).otherwise(held)
    severity = F.greatest(F.coalesce("dated", F.lit(0)), held)
    level = F.lit(None).cast("string")
    for name, s in wx.SEVERITY.items():
        level = F.when(severity == s, F.lit(name)).otherwise(level)
    return (
        weather.join(dated, ["metro_area", "forecast_date"], "left").join(open_start, "metro_area", "left")
        .select(*[c for c in weather.columns if c != "alert_level"], level.alias("alert_level"))
    )


def with_multipliers(weather: DataFrame) -> DataFrame:
    return weather.select(
        "*",
        wx.demand_multiplier(F.col("weather_condition"), F.col("alert_level")).alias("demand_multiplier"),
        wx.delivery_shift(F.col("weather_condition")).alias("channel_shift_delivery"))


def merge_event_sources(events: DataFrame) -> DataFrame:
    """One row per key: the last report wins, except that a lower-trust source
    only fills keys nobody else reported, and there the first report wins."""
    filler = F.col("source") == "seatgeek"
    ranked = events.withColumn("trust", F.when(filler, 0).otherwise(1)).withColumn(
        "recency", F.when(filler, -F.col("report_id")).otherwise(F.col("report_id")))
    return latest(ranked, ["event_id"], "trust", "recency").drop("trust", "recency", "report_id")


def weather_event_lookup(weather: DataFrame, events: DataFrame) -> DataFrame:
    """Weather and event facts per metro and day; either side may be missing.

    Several events on a day collapse to the one with the highest key.
    """
    facts = ["event_category", "est_attendance", "est_demand_multiplier"]
    one = latest(events.select("metro_area", F.col("event_date").alias("forecast_date"), "event_id", *facts),
                 ["metro_area", "forecast_date"], "event_id").drop("event_id")
    return weather.join(one, ["metro_area", "forecast_date"], "full").withColumnRenamed(
        "est_demand_multiplier", "event_demand_multiplier")
