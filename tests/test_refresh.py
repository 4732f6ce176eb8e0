"""The refresh from landed payloads to the outlook."""

import json
from datetime import date, timedelta

from pyspark.sql import functions as F

from platelake.operators import enrich
from platelake.streaming.refresh import Refresh

TODAY = date(2025, 6, 10)


def feeds(spark, days, first=TODAY, alert=None, seats=(), tickets=(), holidays=()):
    daily = {"time": [str(first + timedelta(days=i)) for i in range(days)], "weather_code": [3] * days,
             "temperature_2m_max": [70.0 + i for i in range(days)], "temperature_2m_min": [50.0] * days,
             "precipitation_sum": [None] * days}
    empty = lambda columns: spark.createDataFrame([], columns)
    alerts = [("NY", json.dumps({"features": [{"properties": p} for p in alert or []]}))]
    return {
        "forecasts": spark.createDataFrame([("nyc", json.dumps({"daily": daily}))], "metro_area string, payload string"),
        "alerts": spark.createDataFrame(alerts, "state string, payload string"),
        "holidays": spark.createDataFrame([("NY", json.dumps(list(holidays)))], "state string, payload string") if holidays else empty(
            "state string, payload string"),
        "tickets": spark.createDataFrame([("nyc", json.dumps({"_embedded": {"events": list(tickets)}}))],
                                         "metro_area string, payload string") if tickets else empty("metro_area string, payload string"),
        "seats": spark.createDataFrame([("nyc", json.dumps({"events": list(seats)}))], "metro_area string, payload string") if seats else
        empty("metro_area string, payload string")}


def game(day, title="Game", kind="nba"):
    return {"title": title, "datetime_local": f"{day}T19:30:00", "type": kind, "venue": {"name": "Hall"}}


def test_refresh_to_outlook(spark, tmp_path):
    unit = spark.createDataFrame([(1, "nyc", "NY", 7, 1), (2, "la", "CA", None, 2)],
                                 "unit_id bigint, metro_area string, state string, franchisee_id bigint, region_id bigint")
    job = Refresh(spark, str(tmp_path), unit)
    assert job.outlook(TODAY) is None
    job.run(feeds(spark, 0), TODAY)  # nothing landed
    assert job.outlook(TODAY) is None
    alert = [{"event": "Heat Advisory", "onset": "2025-06-11T06:00:00Z", "expires": "2025-06-12T18:00:00Z"},
             {"event": "Flood Watch", "onset": None, "expires": "2025-06-10T18:00:00Z"},
             {"event": "Storm Warning", "onset": "2025-06-01T00:00:00Z", "expires": None},
             {"event": "Special Statement", "onset": "2025-06-11T06:00:00Z", "expires": "2025-06-19T18:00:00Z"}]
    job.run(feeds(spark, 3, alert=alert, seats=[game("2025-06-11"), game("2025-06-11", "Clowns", "circus"), game("junk")]), TODAY)
    got = {r.forecast_date: r for r in job.outlook(TODAY).collect()}
    assert {d: r.alert_level for d, r in got.items()} == {
        TODAY: "watch", TODAY + timedelta(days=1): "advisory", TODAY + timedelta(days=2): "advisory"}
    assert got[TODAY + timedelta(days=1)].event_name == "Game" and {r.unit_id for r in got.values()} == {1}
    # A later run changes its own days; the history stays.
    again = feeds(spark, 2, first=TODAY + timedelta(days=1), holidays=[
        {"date": "2025-06-12", "localName": "Day", "counties": None}, {"date": "2025-06-12", "localName": "Other", "counties": ["US-CA"]}])
    for _ in range(2):
        job.run(again, TODAY)
        now = {r.forecast_date: r for r in job.outlook(TODAY).collect()}
        assert {d: r.alert_level for d, r in now.items()} == {
            TODAY: "watch", TODAY + timedelta(days=1): None, TODAY + timedelta(days=2): None}
        assert now[TODAY + timedelta(days=2)].event_category == "national_holiday"
        assert job.weather.read().count() == 3 and job.events.read().count() == 2


def test_the_outlook_reads_its_window_only(spark, tmp_path):
    unit = spark.createDataFrame([(1, "nyc", "NY", 7, 1)],
                                 "unit_id bigint, metro_area string, state string, franchisee_id bigint, region_id bigint")
    job = Refresh(spark, str(tmp_path), unit)
    first = date(2025, 1, 1)
    job.run(feeds(spark, 300, first=first, seats=[game(first + timedelta(days=30 * i)) for i in range(10)]), TODAY)
    files = job.outlook(TODAY).inputFiles()
    assert len(files) == 2 and all("=2025-06" in f for f in files)
    before = {f for f in job.weather.read().inputFiles()}
    job.run(feeds(spark, 5), TODAY)
    after = {f for f in job.weather.read().inputFiles()}
    assert len(before - after) == 1 and len(before) == 10  # one month of ten is rewritten
    rows = job.outlook(TODAY, horizon=4).collect()
    assert [r.forecast_date for r in sorted(rows)] == [TODAY + timedelta(days=i) for i in range(5)]


def test_alerts_are_spread_over_given_days(spark):
    weather = spark.createDataFrame([("nyc", date(2025, 6, 10)), ("nyc", date(2025, 6, 11))], "metro_area string, forecast_date date")
    unit = spark.createDataFrame([("nyc", "NY")], "metro_area string, state string")
    alerts = spark.createDataFrame([("NY", "warning", date(1900, 1, 1), date(2999, 1, 1))],
                                   "state string, alert_level string, onset_date date, expires_date date")
    out = enrich.apply_alerts(weather, alerts, unit, F.lit(date(2025, 6, 10)), F.lit(date(2025, 6, 10)))
    assert {r.forecast_date.day: r.alert_level for r in out.collect()} == {10: "warning", 11: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and "min(forecast_date" not in plan
    whole = enrich.apply_alerts(weather, alerts, unit).collect()
    assert {r.alert_level for r in whole} == {"warning"}
