"""Exact learned ranking against scoring every item of the menu."""

import math
import random

import pytest
from pyspark.sql import functions as F

from platelake.operators import learned, recommend
from platelake.operators.features import CATEGORIES

CUSTOMER = "tier string, aov double, " + ", ".join(f"affinity_{c} double" for c in CATEGORIES)
SUPPRESS = ("soda", "cheese")


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(3)
    menu = [(i, f"item {i}", CATEGORIES[rng.randrange(6)], rng.choice(["soda", "cheese", "plain", "other"])) for i in range(1, 121)]
    sold = [(u, i, round(rng.choice([0.0, 0.1, 0.2, 0.35, 0.5, 0.8, 1.0]) * rng.choice([1, 1, 0.97]), 6))
            for u in (1, 2, 3) for i, *_ in menu if rng.random() < (0.95 if u == 1 else 0.4)]
    requests, carts = [], []
    for r in range(80):
        known = r % 3 > 0
        customer = [rng.choice(["gold", "bronze", "none"]), rng.uniform(5, 60)] + [round(rng.random() / 2, 6) for _ in CATEGORIES]
        size = [0, 1, 4, 30][r % 4]
        requests.append((r, [1, 2, 3, 99, None][r % 5], rng.choice([None, 0, 3, 7, 10, 25]), rng.choice([None, 12.5, 31.0]),
                         *(customer if known else [None] * len(customer))))
        carts += [(r, rng.randrange(0, 130)) for _ in range(size)]
    return {
        "menu": spark.createDataFrame(menu, "menu_item_id long, item_name string, category string, subcategory string"),
        "popularity": spark.createDataFrame(sold, "unit_id long, menu_item_id long, popularity double"),
        "requests": spark.createDataFrame(requests, f"request_id long, unit_id long, n int, store_aov double, {CUSTOMER}"),
        "cart": spark.createDataFrame(carts, "request_id long, menu_item_id long"),
        "rows": (menu, sold, requests, carts)}


def brute(rows, score, max_n=10):
    """request -> [(item, score)], every item scored."""
    menu, sold, requests, carts = rows
    cat = {i: c for i, _, c, _ in menu}
    sub = {i: s for i, _, _, s in menu}
    pop = {(u, i): p for u, i, p in sold}
    out = {}
    for r, unit, n, store_aov, tier, aov, *likes in requests:
        cart = {i for q, i in carts if q == r}
        have = {cat[i] for i in cart if i in cat}
        blocked = {sub[i] for i in cart if i in sub and sub[i] in SUPPRESS}
        found = []
        for i in cat:
            if i in cart or sub[i] in blocked:
                continue
            x = {"complement_score": max([recommend.COMPLEMENTS[b].get(cat[i], 0.0) for b in have] + [0.0]),
                 "cust_cat_affinity": likes[CATEGORIES.index(cat[i])] or 0.0, "store_popularity": pop.get((unit, i), 0.0),
                 "cust_aov": aov or 0.0, "store_aov": store_aov or 0.0,
                 "tier_ord": float(recommend.TIER_ORDINALS.get(tier, 0)), **{f"is_cat_{c}": float(cat[i] == c) for c in CATEGORIES}}
            found.append((-round(score(x) * 1_000_000), i))
        out[r] = [(i, -s) for s, i in sorted(found)[:max(1, min(max_n, 5 if n is None else n))]]
    return out


def ranked(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["request_id"], r["rank"])):
        got.setdefault(r["request_id"], []).append((r["menu_item_id"], round(r["score"] * 1_000_000)))
    return got


def leaf(tree, x):
    while isinstance(tree, learned.Split):
        tree = tree.left if x[tree.feature] <= tree.at else tree.right
    return tree


@pytest.mark.parametrize("trees", [
    [learned.Split("store_popularity", 0.2, -0.5, 0.4), learned.Split("is_cat_drinks", 0.5, 0.0, 0.3)],
    [learned.Split("store_popularity", 0.1, 0.9, learned.Split("store_popularity", 0.5, -0.2, 0.1))],  # unsold items first
    [learned.Split("complement_score", 0.5, 0.1, 0.2)],  # popularity plays no part
    [learned.Split("store_popularity", -0.5, 0.4, 0.1), learned.Split("cust_cat_affinity", 0.2, 0.0, 1.0)]])
def test_stated_trees(shop, trees):
    want = brute(shop["rows"], lambda x: 1 / (1 + math.exp(-sum(leaf(t, x) for t in trees))))
    got = learned.rank_learned(shop["requests"], shop["cart"], shop["popularity"], shop["menu"], learned.of_trees(trees), SUPPRESS)
    assert ranked(got) == want


def test_fitted_model(spark, shop):
    menu, sold, requests, carts = shop["rows"]
    rng = random.Random(9)
    rows = []
    for _ in range(1500):
        x = [rng.choice([0.0, 0.3, 0.7]), rng.random() / 2, rng.random(), rng.uniform(0, 60), rng.choice([0.0, 12.5, 31.0]),
             float(rng.randrange(5)), *[0.0] * 6]
        x[6 + rng.randrange(6)] = 1.0
        rows.append((float(rng.random() < 0.2 + 0.5 * x[2] * x[0] + 0.3 * x[1]), *x))
    model = recommend.train_ranker(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ("label", *recommend.FEATURES))),
                                   trees=8)
    scorer = learned.of_model(model)
    assert len(scorer.cuts) > 2
    # The model's own probability of every input row, through its public interface.
    from pyspark.ml.linalg import Vectors

    seen = {}

    def score(x):
        key = tuple(x[c] for c in recommend.FEATURES)
        if key not in seen:
            seen[key] = model.predictProbability(Vectors.dense(key))[1]
        return seen[key]

    some = {"requests": shop["requests"].filter("request_id < 20"), "cart": shop["cart"].filter("request_id < 20")}
    want = brute((menu, sold, requests[:20], [c for c in carts if c[0] < 20]), score)
    got = learned.rank_learned(some["requests"], some["cart"], shop["popularity"], shop["menu"], scorer, SUPPRESS)
    assert ranked(got) == want


def test_batch_falls_back_and_takes_a_limit(shop):
    requests = shop["requests"].select(
        "request_id", F.col("unit_id").alias("store_id"), F.lit(25).alias("num_recommendations"), "tier", "aov", "store_aov",
        *[f"affinity_{c}" for c in CATEGORIES], F.lit("[1,2]").alias("cart_product_ids"), F.lit(3).alias("viewed_product_id"))
    parts = (requests, shop["popularity"], shop["menu"], SUPPRESS)
    plain = recommend.score_batch(*parts).groupBy("request_id").count().collect()
    assert {r["count"] for r in plain} == {10} and len(plain) == 80
    more = recommend.score_batch(*parts, max_n=17).groupBy("request_id").count().collect()
    assert {r["count"] for r in more} == {17}
    trees = [learned.Split("store_popularity", 0.3, 0.0, 1.0)]
    rows = recommend.score_batch(*parts, scorer=learned.of_trees(trees), max_n=12).collect()
    assert len(rows) == 80 * 12 and {r["score"] for r in rows} <= {0.5, round(1 / (1 + math.exp(-1)), 6)}
    assert all(r["menu_item_id"] not in (1, 2, 3) for r in rows)


def test_no_store_meets_the_whole_menu(shop):
    """No cross join, and unsold items come from places, not from pairs of stores and items."""
    got = learned.rank_learned(shop["requests"], shop["cart"], shop["popularity"], shop["menu"],
                               learned.of_trees([learned.Split("store_popularity", 0.3, 0.0, 1.0)]), SUPPRESS)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
