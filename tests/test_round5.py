"""Findings of round 4: joins and rankings that hold at larger tables."""

import re

import pytest
from pyspark.sql import functions as F

from platelake.operators import derive, learned, recommend
from platelake.operators.features import CATEGORIES
from platelake.operators.joins import left_join


def test_generated_prices_are_not_broadcast(spark):
    """The planner sizes the months of an item by the item, so it would send them all to the driver."""
    items = spark.createDataFrame([(10, 1, 7, 2), (11, 1, 8, 1), (12, 2, 7, 3), (13, 2, None, 1)],
                                  "order_item_id long, guest_order_id long, menu_item_id long, quantity int")
    orders = spark.createDataFrame([(1, 5, "carryout", 2), (2, 6, "3pd_delivery", None)],
                                   "guest_order_id long, unit_id long, channel string, financial_period_id long")
    menu = spark.sql("SELECT * FROM VALUES (7L, 10.0D), (8L, 4.0D) AS t(menu_item_id, base_price)")  # of a known size
    prices = menu.select("menu_item_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("financial_period_id")).withColumn(
        "price_multiplier", F.col("financial_period_id") / F.lit(2.0))
    unit = spark.createDataFrame([(5, 1.1), (6, 1.0)], "unit_id long, market_price_index double")
    got = derive.price_line(items, orders, menu, prices, unit)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "financial_period_id" in line for line in plan.splitlines())
    assert not any("Broadcast" in line and "Join" in line and "financial_period_id" in line for line in plan.splitlines())
    assert sorted((r.order_item_id, r.unit_price, r.line_gross_amount) for r in got.collect()) == [
        (10, 11.0, 22.0), (11, 4.4, 4.4), (12, 11.25, 33.75)]


@pytest.fixture(scope="module")
def shop(spark):
    menu = [(i, f"item {i}", CATEGORIES[i % 6], ["soda", "plain"][i % 4 == 0]) for i in range(1, 61)]
    sold = [(u, i, round((i * 7 % 19) / 19, 6)) for u in (1, 2) for i in range(1, 61) if (i + u) % 3]
    asked = [(r, [1, 2, 9, None][r % 4], 3 + r % 5, "gold" if r % 2 else None, 20.0 if r % 2 else None, 9.5,
              *[0.1 * (r % 4) if r % 2 else None] * 6) for r in range(16)]
    carts = [(r, i) for r in range(16) for i in range(1, 61) if (i * 5 + r) % 23 == 0] + [(3, None), (None, 4)]
    likes = ", ".join(f"affinity_{c} double" for c in CATEGORIES)
    return {"requests": spark.createDataFrame(asked, f"request_id long, unit_id long, n int, tier string, aov double, store_aov double, {likes}"),
            "cart": spark.createDataFrame(carts, "request_id long, menu_item_id long"),
            "popularity": spark.createDataFrame(sold, "unit_id long, menu_item_id long, popularity double"),
            "menu_item": spark.createDataFrame(menu, "menu_item_id long, item_name string, category string, subcategory string")}


def exchanges(df):
    """The keys of every exchange of the plan, as planned for large tables."""
    spark = df.sparkSession
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = df.selectExpr("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return [sorted(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_candidates_stay_with_their_request(shop):
    """F5, F7, F8: requests are dealt out by their id; slots, candidates and results never are."""
    found = exchanges(recommend.rank_recommendations(**shop, suppress=("soda",)))
    assert ["request_id"] in found and all(keys == ["request_id"] for keys in found), found


def test_learned_candidates_stay_with_their_request(shop):
    """neither the scores of intervals nor candidates are dealt out."""
    trees = [learned.Split("store_popularity", 0.4, 0.1, learned.Split("cust_aov", 10.0, 0.3, 0.2))]
    found = exchanges(learned.rank_learned(**shop, scorer=learned.of_trees(trees), suppress=("soda",)))
    assert ["request_id"] in found and all(keys == ["request_id"] for keys in found), found


def test_null_keys_are_dealt_out(spark):
    """without heavy keys the salt was folded away, and all anonymous orders met in one task."""
    left = spark.createDataFrame([(1, None), (2, None), (3, 7)], "id long, k long")
    right = spark.createDataFrame([(7, "x"), (None, "y")], "k long, v string")
    out = left_join(left, right, "k")
    assert ["_salt", "k"] in exchanges(out)
    assert sorted((r.id, r.v) for r in out.collect()) == [(1, None), (2, None), (3, "x")]


def test_only_orders_that_meet_their_own_items_walk_on(spark):
    """the walk of an order that meets none of its items ends after as many steps as negatives are wanted."""
    menu = spark.range(1000).select(F.col("id").alias("menu_item_id"))
    items = spark.range(400).select((F.col("id") % 40).alias("guest_order_id"), (F.col("id") * 37 % 1000).alias("menu_item_id"),
                                    F.col("id").alias("order_item_id"))
    wide = spark.range(995).select(F.lit(99).cast("bigint").alias("guest_order_id"), F.col("id").alias("menu_item_id"),
                                   (F.col("id") + 5000).alias("order_item_id"))
    lines = items.unionByName(wide)
    got = recommend.negative_items(lines, recommend.held_out(lines), recommend.numbered(menu))
    rows = [tuple(r) for r in got.collect()]
    mine = {tuple(r) for r in lines.select("guest_order_id", "menu_item_id").collect()}
    assert len(rows) == len(set(rows)) == 41 * 3 and not mine & set(rows)
    assert {i for o, i in rows if o == 99} <= set(range(995, 1000))
    assert "distinct_items" not in got._jdf.queryExecution().optimizedPlan().toString()
