"""Outside-service payloads derived from the given tables, to feed the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.functions import weather as wx
from platelake.functions.ids import event_key
from platelake.operators.silver import latest


def _doc(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols)).alias("payload")


def forecasts(t) -> DataFrame:
    """One document per metro and month: parallel arrays of at most 31 days."""
    day = latest(t.weather_feed.drop("unit_id"), ["metro_area", "forecast_date"], "observation_id")
    rows = day.groupBy("metro_area", F.trunc("forecast_date", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("forecast_date").cast("string").alias("time"), F.col("weather_code").alias("weather_code"),
        F.col("high_temp_f").alias("temperature_2m_max"), F.col("low_temp_f").alias("temperature_2m_min"),
        F.when(F.col("precipitation_inches") > 0, F.col("precipitation_inches")).alias("precipitation_sum")))).alias("d"))
    fields = ("time", "weather_code", "temperature_2m_max", "temperature_2m_min", "precipitation_sum")
    return rows.select("metro_area", F.to_json(F.struct(F.struct(
        *[F.col(f"d.{f}").alias(f) for f in fields]).alias("daily")),
        {"ignoreNullFields": "false"}).alias("payload"))


def alerts(t) -> DataFrame:
    return t.alert_feed.select("state", _doc(F.array(F.struct(F.struct("event", "onset", "expires").alias(
        "properties"))).alias("features")))


def _reports(t, source: str) -> DataFrame:
    return t.happening_feed.filter(F.col("source") == source)


def holidays(t) -> DataFrame:
    k = F.col("report_id")
    counties = F.when(k % 3 == 0, F.array(F.concat(F.lit("US-"), F.col("state")))).when(k % 3 == 1, F.array(F.lit("US-XX")))
    return _reports(t, "nager").select("state", F.to_json(F.array(F.struct(
        F.col("event_date").alias("date"), F.col("event_name").alias("localName"), counties.alias("counties")))).alias("payload"))


def tickets(t) -> DataFrame:
    segment = F.when(F.col("crowd") % 2 == 1, "Sports").otherwise("Music")
    seats = F.when(F.col("crowd") != 9, F.col("crowd"))
    event = F.struct(
        F.col("event_name").alias("name"), F.struct(F.struct(F.col("event_date").alias("localDate")).alias("start")).alias("dates"),
        F.array(F.struct(F.struct(segment.alias("name")).alias("segment"))).alias("classifications"),
        F.struct(F.array(F.struct(F.col("venue").alias("name"), F.struct(seats.alias("_total")).alias("upcomingEvents")))
                 .alias("venues")).alias("_embedded"))
    return _reports(t, "ticketmaster").select("metro_area", _doc(F.struct(F.array(event).alias("events")).alias("_embedded")))


SEAT_TYPES = ("nba", "concert", "theater", "circus", "nfl", "comedy", "mlb", "mls", "nhl")


def seats(t) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(s) for s in SEAT_TYPES]), F.col("crowd").cast("int"))
    event = F.struct(F.col("event_name").alias("title"),
                     F.concat("event_date", F.lit("T19:30:00")).alias("datetime_local"), kind.alias("type"),
                     F.struct(F.col("venue").alias("name")).alias("venue"))
    return _reports(t, "seatgeek").select("metro_area", _doc(F.array(event).alias("events")))


def event_rows(feed: DataFrame, per_metro_holidays: bool = False) -> DataFrame:
    """Reports of the three sources -> one event schema with a stable key.

    Holiday keys leave the metro out, so one row survives for all metros unless
    ``per_metro_holidays`` is set.
    """
    metro, day, name, src = (F.col(c) for c in ("metro_area", "event_date", "event_name", "source"))
    holiday = src == "nager"
    keyed = event_key(src, metro, day, name)
    key = keyed if per_metro_holidays else F.when(holiday, event_key(src, day, name)).otherwise(keyed)
    category = (F.when(holiday, "national_holiday")
                .when((src == "ticketmaster") & (F.col("crowd") % 2 == 1), "major_sports")
                .when((src == "seatgeek") & (F.col("crowd") <= 5), "major_sports").otherwise("concert"))
    seats = (F.when(holiday, F.lit(0)).when(src == "ticketmaster", F.col("crowd") * 1000)
             .otherwise(F.lit(15000))).cast("bigint")
    rows = feed.select(
        "report_id", "metro_area", F.to_date(day).alias("event_date"), key.alias("event_id"),
        name.alias("event_name"), category.alias("event_category"),
        F.when(holiday, "").otherwise(F.col("venue")).alias("venue"), seats.alias("est_attendance"), src)
    return rows.withColumn("est_demand_multiplier", wx.event_multiplier(F.col("event_category")))
