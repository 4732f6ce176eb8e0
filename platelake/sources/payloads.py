"""Landed JSON payloads of the outside services -> rows.

Each parser takes a DataFrame with a ``payload`` string (one document per row)
and the request's own columns, for example the metro.  Schemas are declared, so
nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelake.functions import weather as wx
from platelake.functions.ids import event_key
from platelake.operators.enrich import weather_rows

FORECAST = ("daily struct<time:array<string>,weather_code:array<int>,temperature_2m_max:array<double>,"
            "temperature_2m_min:array<double>,precipitation_sum:array<double>>")
ALERTS = "features array<struct<properties:struct<event:string,onset:string,expires:string>>>"
HOLIDAYS = "array<struct<date:string,localName:string,counties:array<string>>>"
TICKETS = ("_embedded struct<events:array<struct<name:string,dates:struct<start:struct<localDate:string>>,"
           "classifications:array<struct<segment:struct<name:string>>>,"
           "_embedded:struct<venues:array<struct<name:string,upcomingEvents:struct<_total:bigint>>>>>>>")
SEATS = "events array<struct<title:string,datetime_local:string,type:string,venue:struct<name:string>>>"

# Listed event types and their category.
SEAT_CATEGORIES = {"nba": "major_sports", "nfl": "major_sports", "mlb": "major_sports", "nhl": "major_sports",
                   "ncaa_basketball": "major_sports", "ncaa_football": "major_sports", "mls": "major_sports",
                   "concert": "concert", "theater": "concert"}
DEFAULT_ATTENDANCE, SEATS_ATTENDANCE = 5000, 15_000


def forecast(df: DataFrame, today: Column) -> DataFrame:
    """Parallel arrays -> one typed row per metro and day."""
    d = F.from_json("payload", FORECAST)["daily"]
    days = F.arrays_zip(d["time"].alias("time"), d["weather_code"].alias("code"), d["temperature_2m_max"].alias("hi"),
                        d["temperature_2m_min"].alias("lo"), d["precipitation_sum"].alias("rain"))
    rows = df.select("metro_area", F.explode(days).alias("x")).select(
        "metro_area", F.try_to_date("x.time").alias("forecast_date"), F.col("x.code").alias("weather_code"),
        F.col("x.hi").alias("high_temp_f"), F.col("x.lo").alias("low_temp_f"),
        F.col("x.rain").alias("precipitation_inches"))
    return weather_rows(rows, today)


def alerts(df: DataFrame) -> DataFrame:
    """Features of a collection whose event names a level."""
    rows = df.select("state", F.explode(F.from_json("payload", ALERTS)["features"]).alias("f")).select(
        "state", F.coalesce("f.properties.event", F.lit("")).alias("event"), "f.properties.onset", "f.properties.expires")
    return rows.withColumn("alert_level", wx.classify_alert(F.col("event"))).filter(F.col("alert_level").isNotNull())


def holidays(df: DataFrame) -> DataFrame:
    """National holidays and those of the row's ``state``."""
    rows = df.select("state", F.explode(F.from_json("payload", HOLIDAYS)).alias("h"))
    mine = F.col("h.counties").isNull() | F.array_contains("h.counties", F.concat(F.lit("US-"), F.col("state")))
    return rows.filter(mine).select(
        "state", F.try_to_date("h.date").alias("event_date"),
        event_key("nager", F.col("h.date"), F.col("h.localName")).alias("event_id"),
        F.col("h.localName").alias("event_name"), F.lit("national_holiday").alias("event_category"),
        F.lit("").alias("venue"), F.lit(0).cast("bigint").alias("est_attendance"), F.lit("nager").alias("source"))


def _event(source: str, metro: Column, day: Column, name: Column, category: Column, venue: Column,
           attendance: Column) -> list[Column]:
    return [metro.alias("metro_area"), F.try_to_date(day).alias("event_date"),
            event_key(source, metro, day, name).alias("event_id"), name.alias("event_name"),
            category.alias("event_category"), F.coalesce(venue, F.lit("")).alias("venue"),
            attendance.cast("bigint").alias("est_attendance"), F.lit(source).alias("source")]


def ticketmaster(df: DataFrame) -> DataFrame:
    """Nested listings; the first classification and venue count."""
    rows = df.select("metro_area", F.explode(F.from_json("payload", TICKETS)["_embedded"]["events"]).alias("e"))
    segment = F.get("e.classifications", F.lit(0))["segment"]["name"]
    venue = F.get("e._embedded.venues", F.lit(0))
    seats = F.coalesce(venue["upcomingEvents"]["_total"], F.lit(DEFAULT_ATTENDANCE)) * 1000
    category = F.when(segment == "Sports", "major_sports").otherwise("concert")
    return rows.select(*_event("ticketmaster", F.col("metro_area"), F.col("e.dates.start.localDate"), F.col("e.name"),
                               category, venue["name"], seats))


def seatgeek(df: DataFrame) -> DataFrame:
    """Listings of the known types; the date is the first ten characters."""
    rows = df.select("metro_area", F.explode(F.from_json("payload", SEATS)["events"]).alias("e")).filter(
        F.col("e.type").isin(*SEAT_CATEGORIES))
    category = wx.lookup(F.col("e.type"), SEAT_CATEGORIES, "concert")
    return rows.select(*_event("seatgeek", F.col("metro_area"), F.substring("e.datetime_local", 1, 10), F.col("e.title"),
                               category, F.col("e.venue.name"), F.lit(SEATS_ATTENDANCE)))
