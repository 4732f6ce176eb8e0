"""Cases that the SQL checks cannot see."""

import pytest
from pyspark.sql import functions as F

from platelake.functions.loyalty import tier_for_spend
from platelake.functions.numeric import half_up
from platelake.operators import carts, governance, recommend, telemetry
from platelake.sources import payloads


def test_half_up_is_exact(spark):
    rows = [(90071992547409931, 10, 9007199254740993), (5, 10, 1), (4, 10, 0), (0, 3, 0), (25, 10, 3)]
    df = spark.createDataFrame(rows, "n bigint, d bigint, want bigint")
    assert df.filter(half_up(F.col("n"), F.col("d")) != F.col("want")).count() == 0


def test_guest_envelope_is_masked_and_unknown_tables_raise(spark):
    df = spark.createDataFrame([("ann@x.org", "555-123-4567")], "email string, phone string")
    out = governance.mask_by_tag(df, "guest_events").first()
    assert "nn@" not in out["email"] and not out["phone"].startswith("555")
    with pytest.raises(ValueError):
        governance.mask_by_tag(df, "no_such_table")


def test_bad_dates_and_null_names_keep_their_rows(spark):
    text = '[{"date":"","localName":"A"},{"date":"junk","localName":null},{"date":"2024-07-04","localName":"B"}]'
    rows = payloads.holidays(spark.createDataFrame([("TX", text)], "state string, payload string")).collect()
    assert [str(r["event_date"]) for r in rows] == ["None", "None", "2024-07-04"]
    assert len({r["event_id"] for r in rows}) == 3


def test_store_without_state_is_in_the_chain_pool_once(spark):
    pools = telemetry.unit_pools(spark.createDataFrame([(1, None), (2, "TX")], "unit_id bigint, state string")).collect()
    assert {(r["everyone"], r["pool"], r["unit_id"], r["pool_size"]) for r in pools} == {
        (True, "", 1, 2), (True, "", 2, 2), (False, "TX", 2, 1)}


def test_ids_are_not_capped(spark):
    df = spark.createDataFrame([("9001 x2, 75x1, 0 x3", " 50001 "), (None, "-4")], "skus string, member string")
    got = df.select(telemetry.parse_skus(F.col("skus")).alias("s"), telemetry.parse_member_id(F.col("member")).alias("m")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [(9001, 2), (75, 1)] and got[0]["m"] == 50001
    assert got[1]["s"] == [] and got[1]["m"] is None


def test_records_without_time_are_left_out(spark):
    df = spark.createDataFrame([("a", 1_000_000_000, {"app.order.amount": "3.5"}), ("b", None, {"app.order.amount": "3.5"})],
                               "trace_id string, time_unix_nano bigint, attributes map<string,string>")
    assert [r["trace_id"] for r in telemetry.logs_scan(df).collect()] == ["a"]


def test_occasions_beyond_the_first_events(spark):
    rows = [("m", i, f"2024-01-{1 + i % 28:02d}", f"e{i:04d}") for i in range(400)] + [("m", 999, "2025-03-02", "late")]
    events = spark.createDataFrame(rows, "metro_area string, n int, event_date string, event_id string").withColumns(
        {"event_date": F.to_date("event_date"), "event_name": F.col("event_id"), "event_category": F.lit("x")})
    unit = spark.createDataFrame([(1, "m")], "unit_id bigint, metro_area string")
    assert [r["event_name"] for r in carts.occasions(unit, events, "2025-03").collect()] == ["late"]
    assert carts.occasions(unit, events, "2030-01").count() == 5 and carts.occasions(unit, events).count() == 5


def test_request_fields_that_are_no_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (7.0,), (1e300,)], "v double")
    assert [r[0] for r in df.select(recommend._whole("v")).collect()] == [None, None, 7, None]


def test_tiers_at_their_floors(spark):
    df = spark.createDataFrame([(0.0,), (499.99,), (500.0,), (1500.0,), (3500.0,)], "s double")
    assert [r[0] for r in df.select(tier_for_spend(F.col("s"))).collect()] == ["bronze", "bronze", "silver", "gold", "platinum"]


def test_telemetry_reads_logs_and_spans_once(spark, tmp_path):
    from tests.test_operators import telemetry_frames

    stored = []
    for name, df in zip(("logs", "spans", "unit"), telemetry_frames(spark)):
        df.write.parquet(f"{tmp_path}/{name}")
        stored.append(spark.read.parquet(f"{tmp_path}/{name}"))
    plan = telemetry.reshape_orders(*stored)._jdf.queryExecution().optimizedPlan().toString()
    # Once for the rows; the logs also name the wanted traces, the store dimension is numbered and counted, by state and whole.
    assert plan.count("Relation [trace_id") == 3 and plan.count("Relation [unit_id") <= 4 and plan.count("Generate explode") <= 5


def test_a_filter_joins_only_what_it_names(spark):
    from platelake.operators.metric_view import Join, Field, MetricView

    sales = spark.createDataFrame([(1, 7, 2.0), (2, 8, 3.0), (1, 8, 4.0)], "unit_id int, item int, amount double")
    unit = spark.createDataFrame([(1, "A"), (2, "B")], "unit_id int, store string")
    item = spark.createDataFrame([(7, "x"), (8, "y")], "item int, kind string")
    view = MetricView(sales, {"Store": Field(F.col("store"), ["unit"]), "Kind": Field(F.col("kind"), ["item"])},
                      {"Total": F.sum("amount")}, {"unit": Join(unit, "unit_id", {"store": "store"}),
                                                   "item": Join(item, "item", {"kind": "kind"})})
    out = view.query(["Store"], ["Total"], {"Store": lambda c: c == "A"})
    assert [tuple(r) for r in out.collect()] == [("A", 6.0)]
    assert out._jdf.queryExecution().analyzed().toString().count("Join LeftOuter") == 1


def test_request_without_a_candidate_has_an_empty_list(spark):
    menu = spark.createDataFrame([(1, "Soda", "drinks", "cola"), (2, "Pie", "pizza", "plain")],
                                 "menu_item_id bigint, item_name string, category string, subcategory string")
    sold = spark.createDataFrame([(1, 1, 1.0)], "unit_id bigint, menu_item_id bigint, popularity double")
    likes = ", ".join(f"affinity_{c} double" for c in recommend.CATEGORIES)
    none = [None] * len(recommend.CATEGORIES)
    asked = spark.createDataFrame([(1, 1, "[1,2]", None, 3, None, *none), (2, 1, "[2]", None, 3, "gold", *none)],
                                  "request_id bigint, store_id bigint, cart_product_ids string, viewed_product_id bigint, "
                                  f"num_recommendations int, tier string, {likes}")
    got = {r.request_id: r for r in recommend.score_lists(asked, sold, menu).collect()}
    assert got[1].recommendations == [] and not got[1].personalized
    assert [x.menu_item_id for x in got[2].recommendations] == [1] and got[2].personalized


def test_keys_are_checked_for_every_table(spark):
    from platelake.operators import quality

    orders = spark.createDataFrame([(1,), (1,), (2,)], "guest_order_id bigint")
    paid = spark.createDataFrame([(5, 1), (6, 9), (7, None)], "payment_id bigint, guest_order_id bigint")
    out = quality.key_checks({"guest_order": orders, "payment": paid}, {"guest_order": "guest_order_id", "payment": "payment_id"},
                             {"payment": ("guest_order",)})
    assert {r.check_name: r.violations for r in out.collect()} == {
        "guest_order_key_unique": 1, "payment_key_unique": 0, "payment_has_guest_order": 1}
