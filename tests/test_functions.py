"""Column functions against hand-computed values."""

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from platelake.functions import masks, weather as wx
from platelake.functions.ids import event_key, make_id
from platelake.functions.loyalty import points_earned, tier_for_spend, tier_to_multiplier
from platelake.operators import derive, recommend, telemetry


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_make_id_matches_sha256_prefix(spark):
    want = int(hashlib.sha256(b"otel:abc:3").hexdigest()[:14], 16)
    assert one(spark, make_id("otel", F.lit("abc"), 3).alias("x")).x == want


def test_event_key(spark):
    want = hashlib.sha256(b"nager:2026-07-04:Independence Day").hexdigest()[:16]
    assert one(spark, event_key("nager", "2026-07-04", "Independence Day").alias("x")).x == want


@pytest.mark.parametrize("text,want", [
    ('["41 x5","7 x10"]', [(41, 5), (7, 10)]), ("garbage", []), (None, []), ("0 x2, 76 x1, 1 X3, 75x4", [(76, 1), (1, 3), (75, 4)]),
    ("5 x0", []), ("12  x  2", [(12, 2)])])
def test_parse_skus(spark, text, want):
    got = one(spark, telemetry.parse_skus(F.lit(text).cast("string")).alias("x")).x
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("text,want", [("12345", 12345), (" 7 ", 7), ("0", None), ("50001", 50001), ("-3", None), ("x", None), (None, None)])
def test_parse_member_id(spark, text, want):
    assert one(spark, telemetry.parse_member_id(F.lit(text).cast("string")).alias("x")).x == want


def test_event_time_prefers_text_then_nanos(spark):
    nanos = F.lit(1749686400000000999)
    row = one(spark, telemetry.event_time(F.lit("2025-06-12T04:00:00"), nanos).alias("a"),
              telemetry.event_time(F.lit(None).cast("string"), nanos).alias("b"))
    assert row.a == datetime(2025, 6, 12, 4) and row.b == datetime(2025, 6, 12)


def test_masks(spark):
    row = one(spark, masks.mask_email(F.lit("alice@x.com")).alias("a"), masks.mask_email(F.lit("a@x.com")).alias("b"),
              masks.mask_email(F.lit("@x.com")).alias("c"), masks.mask_phone(F.lit("(555) 010-1234")).alias("d"),
              masks.mask_phone(F.lit("12")).alias("e"), masks.mask_email(F.lit(None).cast("string")).alias("f"))
    assert tuple(row) == ("a****@x.com", "a@x.com", "***", "******1234", "12", None)


@pytest.mark.parametrize("code,want", [(0, "clear"), (45, "clear"), (55, "rain"), (61, "rain"), (65, "heavy_rain"),
                                       (72, "snow"), (75, "heavy_snow"), (83, "heavy_rain"), (95, "storm"), (60, "clear")])
def test_wmo(spark, code, want):
    assert one(spark, wx.wmo_condition(F.lit(code)).alias("x")).x == want


def test_weather_rules(spark):
    row = one(
        spark, wx.temperature_override(F.lit("rain"), F.lit(101.0), F.lit(5.0)).alias("hot"),
        wx.temperature_override(F.lit("rain"), F.lit(50.0), F.lit(5.0)).alias("cold"),
        wx.classify_alert(F.lit("Winter Storm WARNING watch")).alias("alert"), wx.classify_alert(F.lit("Statement")).alias("none"),
        wx.demand_multiplier(F.lit("storm"), F.lit("warning")).alias("storm"),
        wx.demand_multiplier(F.lit("unknown"), F.lit(None).cast("string")).alias("unknown"),
        F.round(wx.combine(F.lit(2.0), F.lit(1.6)), 4).alias("cap"), wx.risk_level(F.lit(0.79)).alias("risk"),
        wx.risk_level(F.lit(1.41)).alias("surge"), wx.event_multiplier(F.lit(None).cast("string")).alias("no_event"))
    assert tuple(row) == ("extreme_heat", "extreme_cold", "warning", None, 0.4, 1.0, 2.5, "demand_risk", "capacity_risk", 1.0)


@pytest.mark.parametrize("day,name,mult", [
    (date(2025, 2, 9), "super_bowl", 3.2), (date(2025, 10, 31), "halloween", 1.8), (date(2025, 11, 28), "black_friday", 1.6),
    (date(2025, 9, 7), "nfl_sunday", 2.0), (date(2025, 6, 6), "summer_friday", 1.4), (date(2025, 1, 7), None, 0.85),
    (date(2025, 12, 25), "christmas_day", 0.7), (date(2025, 4, 8), None, 1.0), (date(2025, 9, 5), None, 1.0)])
def test_calendar(spark, day, name, mult):
    got = one(spark, derive.classify_day(F.lit(day)).alias("c")).c
    assert (got.holiday_name, got.event_multiplier) == (name, mult)


def test_tiers_and_points(spark):
    rows = spark.createDataFrame([(0.0,), (499.99,), (500.0,), (1500.0,), (3500.0,)], "s double").select(
        tier_for_spend(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == ["bronze", "bronze", "silver", "gold", "platinum"]
    row = one(spark, points_earned(F.lit(19.99), F.lit("silver")).alias("p"), tier_to_multiplier(F.lit("elite")).alias("e"),
              tier_to_multiplier(F.lit("platinum")).alias("q"), derive.hours_worked(
                  F.lit(datetime(2026, 1, 1, 10)), F.lit(datetime(2026, 1, 2, 11, 30))).alias("h"),
              derive.hours_worked(F.lit(datetime(2026, 1, 1, 10)), F.lit(datetime(2026, 1, 2, 11, 30)), wrap_days=True).alias("w"))
    assert tuple(row) == (249, 3.0, 1.0, 25.5, 1.5)


def test_channel_mix(spark):
    mix = derive.channel_mix(F.lit(23), F.lit(0.25))
    row = one(spark, *[c.alias(n) for n, c in mix.items()])
    assert [round(row[n], 6) for n in ("3pd_delivery", "own_delivery", "carryout", "catering")] == [0.8, 0.16, 0.0, 0.04]


@pytest.mark.parametrize("raw,want", [("[1, 2]", [1, 2]), ("3,4", [3, 4]), (None, []), ("[]", []), ("junk", [])])
def test_parse_cart(spark, raw, want):
    assert one(spark, recommend.parse_cart(F.lit(raw).cast("string")).alias("x")).x == want
