"""Outside payloads -> stored weather and events -> demand outlook, as one job.

Both tables are keyed and hold a folder for each month.  A run rewrites the months that its payloads name, alerts are spread
over their days only, and the outlook reads the one or two folders of its window, however long the history is.  A run that is repeated gives
the same tables; one that is lost leaves them as they were.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelake.functions import weather as wx
from platelake.operators import enrich, views
from platelake.operators.silver import latest
from platelake.sources import payloads
from platelake.sources.keyed import KeyedTable
from platelake.sources.workspace import stored


class Refresh:
    """``run`` takes in landed payloads; ``outlook`` is the forecast from what is stored."""

    def __init__(self, spark: SparkSession, root: str, unit: DataFrame, keep: int = 2):
        self.unit = unit
        self.weather = KeyedTable(spark, f"{root}/weather", ["metro_area", "forecast_date"], keep=keep, by="forecast_date",
                                  chars=MONTH)
        self.events = KeyedTable(spark, f"{root}/local_events", ["event_id", "event_date"], keep=keep, by="event_date",
                                 chars=MONTH)

    def run(self, feeds: Mapping[str, DataFrame], today: date) -> None:
        """``feeds``: forecasts, alerts, holidays, tickets and seats, each with a ``payload`` and its request's columns.

        Weather and events without a day are left out, as no outlook can use them.
        """
        weather = payloads.forecast(feeds["forecasts"], F.lit(today)).filter(F.col("forecast_date").isNotNull())
        weather = stored(latest(weather, ["metro_area", "forecast_date"], "high_temp_f", "low_temp_f", "weather_condition"), "weather")
        span = weather.agg(F.min("forecast_date").alias("first"), F.max("forecast_date").alias("last")).first()
        if span["first"] is not None:
            alerts = enrich.classified_alerts(payloads.alerts(feeds["alerts"]))
            alerted = enrich.apply_alerts(weather, alerts, self.unit, F.lit(span["first"]), F.lit(span["last"]))
            self.weather.upsert(enrich.with_multipliers(alerted))
        events = self.local_events(feeds)
        if not events.isEmpty():
            self.events.upsert(events)

    def local_events(self, feeds: Mapping[str, DataFrame]) -> DataFrame:
        """One row per event; of reports with one key the largest attendance, then venue, category and metro wins.

        Holidays are reported per state and hold in all its metros, but their key leaves the metro out.
        """
        metros = self.unit.select("metro_area", "state").distinct()
        holidays = payloads.holidays(feeds["holidays"]).join(metros, "state").drop("state")
        rows = holidays.unionByName(payloads.ticketmaster(feeds["tickets"])).unionByName(payloads.seatgeek(feeds["seats"]))
        one = latest(rows.filter(F.col("event_date").isNotNull()), ["event_id", "event_date"], "est_attendance", "venue",
                     "event_category", "metro_area")
        return stored(one.withColumn("est_demand_multiplier", wx.event_multiplier(F.col("event_category"))), "events")

    def outlook(self, today: date, horizon: int = 14, one_row_per_day: bool = False) -> DataFrame | None:
        """Demand outlook per unit and day; None before the first weather."""
        first, last = str(today), str(today + timedelta(days=horizon))
        weather, events = (t.read_between(first, last) for t in (self.weather, self.events))
        if weather is None:
            return None
        if events is None:
            events = self.weather.spark.createDataFrame([], EVENTS)
        return views.demand_risk_forecast(self.unit, weather, events, F.lit(today), horizon, one_row_per_day)


MONTH = len("2024-01")
EVENTS = ("metro_area string, event_date date, event_id string, event_name string, event_category string, venue string, "
          "est_attendance bigint, source string, est_demand_multiplier double")
