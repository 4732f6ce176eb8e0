"""Feature, recommender, cart and governance queries."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import functions as F

from platelake.functions.loyalty import tier_to_multiplier
from platelake.functions.masks import mask_email, mask_phone
from platelake.operators import carts, features, governance, learned, profile, recommend
from platelake.operators.features import CATEGORIES
from platelake.operators.joins import heavy_keys, left_join
from platelake.operators.learned import Split
from platelake.operators.tables import rows
from platelake.plans.duck import HU, NOW_ORD, R, S, TODAY, A, fx, mid
from platelake.plans.registry import query
from platelake.sources import sinks

# Subcategories are brand names in the supplied tables; two of them stand in for the suppressed ones.
SUPPRESS = ("Brand#1", "Brand#2")

# ---- features
query("latest_tier", "SELECT * FROM latest_tier")(lambda t: features.latest_tier(t.loyalty_transaction))
query("customer_features", "SELECT * FROM customer_features")(lambda t: t.customer_features)
TOP = "SELECT unit_id, category, menu_item_id FROM item_popularity JOIN menu_item USING (menu_item_id) QUALIFY row_number() OVER (PARTITION BY unit_id, category ORDER BY quantity DESC, menu_item_id)=1"
query("store_features", f"""SELECT unit_id, metro_area, region_id, franchisee_id, store_orders, store_aov, """ + ", ".join(
    f"max(menu_item_id) FILTER (WHERE category='{c}') top_{c}" for c in CATEGORIES) + f""" FROM store_aov JOIN unit USING (unit_id)
      LEFT JOIN ({TOP}) USING (unit_id) GROUP BY ALL""")(lambda t: t.store_features.select(
          *[c for c in t.store_features.columns if c != "top_item_per_category"],
          *[F.col("top_item_per_category")[c].alias(f"top_{c}") for c in CATEGORIES]))
query("store_features_json", f"""SELECT unit_id, '{{'||string_agg('"'||category||'":'||menu_item_id, ',' ORDER BY
      list_position({list(CATEGORIES)},category))||'}}' top_item_per_category FROM ({TOP}) GROUP BY 1""")(
    lambda t: features.serialised(t.store_features).select("unit_id", "top_item_per_category"))
query("store_popularity", "SELECT * FROM item_popularity")(lambda t: t.item_popularity)
query("heavy_store_lookup", """SELECT guest_order_id request_id, s.store_aov, cf.tier FROM guest_order g
      LEFT JOIN store_aov s ON s.unit_id=CASE WHEN g.guest_order_id%2=0 THEN 3 ELSE g.unit_id END
      LEFT JOIN customer_features cf ON cf.profile_id=g.profile_id""")(lambda t: heavy_store_lookup(t))


def heavy_store_lookup(t):
    """Orders looked up in both feature tables, half of them sent to one store."""
    asked = t.guest_order.select(F.col("guest_order_id").alias("request_id"), "profile_id",
                                 F.when(F.col("guest_order_id") % 2 == 0, F.lit(3)).otherwise(F.col("unit_id")).cast("bigint").alias("store_id"))
    customers, stores, _ = t.feature_tables
    heavy = tuple(heavy_keys(asked, "store_id", 0.1))
    return features.feature_lookup(asked, customers, stores.select("unit_id", "store_aov"), heavy).select("request_id", "store_aov", "tier")


query("feature_lookup", """SELECT event_id request_id, cf.tier, cf.aov, s.store_aov, u.metro_area FROM events
      LEFT JOIN customer_features cf ON cf.profile_id=user_id LEFT JOIN store_aov s ON s.unit_id=user_id%25
      LEFT JOIN unit u ON u.unit_id=s.unit_id""")(lambda t: features.feature_lookup(
          event_requests(t), t.customer_features, t.store_features).select("request_id", "tier", "aov", "store_aov", "metro_area"))


def event_requests(t):
    """One recommendation request per user event, cart and viewed item taken from its fields."""
    e, u = F.col("event_id"), F.col("user_id")
    size = F.lit(t.menu_item.count())
    text = lambda c: c.cast("string")
    a, b = (e * 7) % size, (e * 13 + 1) % size
    cart = (F.when(e % 5 == 0, F.concat(F.lit("["), text(a), F.lit(","), text(b), F.lit("]")))
            .when(e % 5 == 1, F.concat(text(a), F.lit(","), text(b))).when(e % 5 == 2, F.concat(F.lit("["), text(a), F.lit("]")))
            .when(e % 5 == 3, F.lit("[]")))
    return t.raw("events").select(
        e.alias("request_id"), u.alias("profile_id"), (u % 25).alias("store_id"), cart.alias("cart_product_ids"),
        F.when(e % 4 == 0, (e * 3) % size).when(e % 4 == 1, F.lit(0)).alias("viewed_product_id"),
        F.when(e % 3 != 0, (e % 14).cast("int")).alias("num_recommendations"))


# ---- recommender
CART = "(SELECT DISTINCT guest_order_id request_id, menu_item_id FROM order_item)"


def order_cart(t):
    return t.order_item.select(F.col("guest_order_id").alias("request_id"), "menu_item_id")


def order_requests(t):
    known = t.known_customers.select("profile_id", "tier", *[f"affinity_{c}" for c in CATEGORIES])
    return t.guest_order.select(F.col("guest_order_id").alias("request_id"), "unit_id", "profile_id",
                                (F.col("guest_order_id") % 13).cast("int").alias("n")).transform(left_join, known, "profile_id")


def flags_sql(cart: str) -> str:
    return "(SELECT request_id, " + ", ".join(f"bool_or(category='{c}') has_{c}" for c in CATEGORIES) + (
        f" FROM {cart} JOIN menu_item USING (menu_item_id) GROUP BY 1)")


def comp_sql(category: str = "m.category") -> str:
    arms = " ".join("WHEN '" + c + "' THEN greatest(0," + ",".join(
        f"CASE WHEN has_{b} THEN {int(w[c] * 10 + 0.5)} ELSE 0 END" for b, w in recommend.COMPLEMENTS.items() if c in w) + ")"
        for c in CATEGORIES)
    return f"(CASE {category} {arms} END)"


FILLED = "(" + " OR ".join(f"coalesce(has_{c},false)" for c in CATEGORIES) + ")"
ANCHOR = "coalesce(" + ",".join(f"CASE WHEN has_{c} THEN '{c}' END" for c in sorted(CATEGORIES)) + ")"
AFF = "coalesce(CASE m.category " + " ".join(f"WHEN '{c}' THEN affinity_{c}" for c in CATEGORIES) + " END,0.0)"


def ranked_sql(req: str, cart: str, extra: str = "", micro: str | None = None) -> str:
    """Every request against every menu item: the plain definition of the ranking, under the blended score or ``micro``."""
    score = (f"CASE WHEN filled THEN 55*comp*100000+25*{fx('aff', 1000000)}+20*{fx('pop', 1000000)} "
             f"ELSE 55*{fx('aff', 1000000)}+45*{fx('pop', 1000000)} END")
    return f"""SELECT request_id, CAST(rank AS INTEGER) rank, menu_item_id, item_name, category, subcategory,
      CAST(micro AS BIGINT)/1000000.0::DOUBLE score, reason||CASE WHEN tier IN ('gold','platinum') THEN '; '||tier||'-tier favorite' ELSE '' END reason{extra}
      FROM (SELECT *, CASE WHEN category='drinks' AND filled AND NOT has_drinks THEN 'complements your order; no drink in cart'
      WHEN comp>=5 AND filled THEN 'complements '||anchor WHEN NOT filled THEN 'popular at this store' ELSE 'frequently added' END reason
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY micro DESC, menu_item_id) rank FROM
      (SELECT *, {micro or HU(score, '100')} micro FROM (SELECT r.*, m.menu_item_id, item_name, category, subcategory, {FILLED} filled,
      {ANCHOR} anchor, coalesce(has_drinks,false) has_drinks, {comp_sql()} comp, {AFF} aff, coalesce(p.popularity,0.0) pop,
      least(10,greatest(1,coalesce(n,5))) k FROM {req} r CROSS JOIN menu_item m
      LEFT JOIN {flags_sql(cart)} f USING (request_id) LEFT JOIN item_popularity p ON p.unit_id=r.unit_id AND p.menu_item_id=m.menu_item_id
      ANTI JOIN {cart} c ON c.request_id=r.request_id AND c.menu_item_id=m.menu_item_id
      ANTI JOIN (SELECT DISTINCT request_id, subcategory FROM {cart} JOIN menu_item USING (menu_item_id) WHERE subcategory IN {SUPPRESS}) s
      ON s.request_id=r.request_id AND s.subcategory=m.subcategory)) QUALIFY rank<=k))"""


query("cart_categories", f"""SELECT request_id, array_to_string(list_sort(list_distinct(list(category))),',') categories
      FROM {CART} JOIN menu_item USING (menu_item_id) GROUP BY 1""")(
    lambda t: recommend.basket_flags(order_cart(t), t.menu_item).select(
        "request_id", F.array_join("cart_categories", ",").alias("categories")))
query("complement_score", "SELECT request_id, " + ", ".join(
    f"{comp_sql(chr(39) + c + chr(39))}/10.0::DOUBLE complement_{c}" for c in CATEGORIES) + f" FROM {flags_sql(CART)}")(
    lambda t: recommend.basket_flags(order_cart(t), t.menu_item).select(
        "request_id", *[recommend.complement_score(c).alias(f"complement_{c}") for c in CATEGORIES]))
query("suppress_subcategory", f"""SELECT DISTINCT request_id, subcategory FROM {CART} JOIN menu_item USING (menu_item_id)
      WHERE subcategory IN {SUPPRESS}""")(lambda t: recommend.suppressed(order_cart(t), t.menu_item, SUPPRESS))
REQ = "(SELECT guest_order_id request_id, unit_id, CAST(guest_order_id%13 AS INTEGER) n, tier, " + ", ".join(
    f"affinity_{c}" for c in CATEGORIES) + " FROM guest_order LEFT JOIN customer_features USING (profile_id))"
query("rank_recommendations", ranked_sql(REQ, CART))(lambda t: recommend.rank_recommendations(
    order_requests(t), order_cart(t), t.known_popularity, t.menu_item, SUPPRESS))
SIZE = "(SELECT count(*) FROM menu_item)"
BATCH = "(SELECT event_id request_id, user_id%25 unit_id, CASE WHEN event_id%3<>0 THEN CAST(event_id%14 AS INTEGER) END n, tier, profile_id IS NOT NULL personalized, " + ", ".join(
    f"affinity_{c}" for c in CATEGORIES) + " FROM events LEFT JOIN customer_features ON profile_id=user_id)"
BATCH_CART = f"""(SELECT event_id request_id, (event_id*7)%{SIZE} menu_item_id FROM events WHERE event_id%5<=2 UNION
      SELECT event_id, (event_id*13+1)%{SIZE} FROM events WHERE event_id%5<=1 UNION
      SELECT event_id, (event_id*3)%{SIZE} FROM events WHERE event_id%4=0 AND (event_id*3)%{SIZE}<>0)"""
query("score_batch", ranked_sql(BATCH, BATCH_CART, ", personalized"))(lambda t: recommend.score_batch(
    event_requests(t).join(t.known_customers, "profile_id", "left"), t.known_popularity, t.menu_item, SUPPRESS))

# Stated trees for the check of the learned ranking; fitted ones are checked by brute force in the tests.
RULES = [
    Split("store_popularity", 0.35, Split("complement_score", 0.45, -0.4, 0.15), Split("is_cat_drinks", 0.5, 0.1, 0.55)),
    Split("cust_cat_affinity", 0.18, Split("store_popularity", 0.62, -0.25, 0.2), Split("store_popularity", 0.35, 0.05, 0.4)),
    Split("store_popularity", 0.8, Split("tier_ord", 1.5, -0.1, 0.12), Split("cust_aov", 250.0, 0.3, 0.7)),
    Split("complement_score", 0.65, Split("is_cat_desserts", 0.5, -0.05, -0.3), Split("store_popularity", 0.15, 0.0, 0.35)),
]


def tree_sql(tree) -> str:
    if not isinstance(tree, Split):
        return repr(float(tree))
    return f"(CASE WHEN {tree.feature}<={tree.at!r} THEN {tree_sql(tree.left)} ELSE {tree_sql(tree.right)} END)"


INPUTS = {"complement_score": "comp/10.0::DOUBLE", "cust_cat_affinity": "aff::DOUBLE", "store_popularity": "pop",
          "cust_aov": "coalesce(aov,0.0)", "store_aov": "coalesce(store_aov,0.0)",
          "tier_ord": "CASE tier " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in recommend.TIER_ORDINALS.items()) + " ELSE 0 END",
          **{f"is_cat_{c}": f"CASE WHEN category='{c}' THEN 1 ELSE 0 END" for c in CATEGORIES}}


def rules_sql() -> str:
    margin = "(0.0::DOUBLE+" + "+".join(tree_sql(t) + "::DOUBLE" for t in RULES) + ")"
    for name, value in INPUTS.items():
        margin = re.sub(rf"\b{name}<=", f"({value})<=", margin)
    return f"CAST(round(1.0::DOUBLE/(1.0::DOUBLE+exp(-{margin}))*1000000.0::DOUBLE) AS BIGINT)"


BATCH_AOV = BATCH.replace("tier, profile_id IS NOT NULL", "tier, aov, store_aov, profile_id IS NOT NULL").replace(
    "ON profile_id=user_id)", "ON profile_id=user_id LEFT JOIN store_aov s ON s.unit_id=user_id%25)")


def enriched(t):
    return features.feature_lookup(event_requests(t), t.known_customers, t.known_store_values)


query("score_batch_rules", ranked_sql(BATCH_AOV, BATCH_CART, ", personalized", rules_sql()))(lambda t: recommend.score_batch(
    enriched(t), t.known_popularity, t.menu_item, SUPPRESS, learned.of_trees(RULES)))
query("score_batch_learned")(lambda t: recommend.score_batch(
    enriched(t), t.known_popularity, t.menu_item, SUPPRESS, learned.of_model(recommend.train_ranker(stored_training(t), trees=20))))

query("recommendation_lists", f"""SELECT b.request_id, b.personalized, count(r.rank) offered,
      coalesce(string_agg(r.menu_item_id, ',' ORDER BY r.rank),'') items FROM {BATCH} b
      LEFT JOIN ({ranked_sql(BATCH, BATCH_CART)}) r USING (request_id) GROUP BY 1, 2""")(
    lambda t: recommend.score_lists(event_requests(t).join(t.known_customers, "profile_id", "left"), t.known_popularity,
                                    t.menu_item, SUPPRESS).select(
        "request_id", "personalized", F.size("recommendations").cast("bigint").alias("offered"),
        F.array_join(F.transform("recommendations", lambda r: r["menu_item_id"].cast("string")), ",").alias("items")))

HELD = """(SELECT guest_order_id request_id, order_item_id, menu_item_id FROM (SELECT *, count(*) OVER (PARTITION BY guest_order_id) k
      FROM order_item) WHERE k>=2 QUALIFY row_number() OVER (PARTITION BY guest_order_id ORDER BY order_item_id DESC)=1)"""
BASKET = f"""(SELECT DISTINCT guest_order_id request_id, menu_item_id FROM order_item WHERE order_item_id NOT IN (SELECT order_item_id FROM {HELD})
      AND guest_order_id IN (SELECT request_id FROM {HELD}))"""
NEG = f"""(SELECT request_id, menu_item_id FROM (SELECT request_id, step, ({mid("'neg'", 'request_id')}+step)%{SIZE} slot FROM
      (SELECT request_id, unnest(range(least(d+3,{SIZE}))) step FROM {HELD} JOIN (SELECT guest_order_id request_id,
      count(DISTINCT menu_item_id) d FROM order_item GROUP BY 1) USING (request_id))) w JOIN (SELECT menu_item_id,
      row_number() OVER (ORDER BY menu_item_id)-1 slot FROM menu_item) USING (slot) ANTI JOIN {CART} c USING (request_id, menu_item_id)
      QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY step)<=3)"""
PAIRS = f"(SELECT request_id, menu_item_id, 1.0::DOUBLE AS label FROM {HELD} UNION ALL SELECT *, 0.0::DOUBLE FROM {NEG})"
TIER_ORD = "CASE tier " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in recommend.TIER_ORDINALS.items()) + " ELSE 0 END::DOUBLE"
query("negative_items", f"SELECT request_id guest_order_id, menu_item_id FROM {NEG}")(
    lambda t: recommend.negative_items(t.order_item, recommend.held_out(t.order_item), recommend.numbered(t.menu_item.select("menu_item_id"))))
query("build_feature_vector", f"""SELECT request_id, menu_item_id, label, coalesce({comp_sql()},0)/10.0::DOUBLE complement_score,
      {AFF}::DOUBLE cust_cat_affinity, coalesce(popularity,0.0::DOUBLE) store_popularity, coalesce(aov,0.0::DOUBLE) cust_aov,
      coalesce(store_aov,0.0::DOUBLE) store_aov, ({TIER_ORD.replace('::DOUBLE', '')})::DOUBLE tier_ord, """ + ", ".join(
    f"(CASE WHEN category='{c}' THEN 1 ELSE 0 END)::DOUBLE is_cat_{c}" for c in CATEGORIES) + f""" FROM {PAIRS} x
      JOIN menu_item m USING (menu_item_id) JOIN guest_order g ON g.guest_order_id=request_id
      LEFT JOIN {flags_sql(BASKET)} f USING (request_id) LEFT JOIN customer_features cf ON cf.profile_id=g.profile_id
      LEFT JOIN store_aov s ON s.unit_id=g.unit_id LEFT JOIN item_popularity p ON p.unit_id=g.unit_id AND p.menu_item_id=x.menu_item_id""")(
    lambda t: training(t).drop("profile_id", "unit_id"))
query("training_set", f"SELECT label, count(*) AS examples FROM {PAIRS} GROUP BY 1")(
    lambda t: training(t).groupBy("label").agg(rows().alias("examples")))
query("train_ranker")(lambda t: train_ranker(t))


def training(t):
    return recommend.training_set(t.guest_order, t.order_item, t.known_customers, t.known_store_values, t.known_popularity, t.menu_item)


def stored_training(t):
    """What the fit reads, written first: it passes over the rows again and again."""
    return sinks.settled(training(t).select("label", *recommend.FEATURES), "training")


def train_ranker(t, trees: int = 100):
    """Fit on all orders, then report accuracy over the training rows."""
    rows_ = stored_training(t)
    scored = recommend.learned_scores(recommend.train_ranker(rows_, trees), rows_)
    right = (F.col("score") >= 0.5).cast("double") == F.col("label")
    return scored.agg(rows().alias("examples"), (F.count_if(right) / rows()).alias("train_accuracy"),
                      F.round(F.avg(F.when(F.col("label") == 1, F.col("score"))), 6).alias("mean_positive_score"),
                      F.round(F.avg(F.when(F.col("label") == 0, F.col("score"))), 6).alias("mean_negative_score"))


# ---- carts
query("menu_search", """SELECT menu_item_id, item_name, category, subcategory, base_price price FROM menu_item
      WHERE category='pizza' AND lower(item_name) LIKE '%ring%'""")(lambda t: carts.menu_search(t.menu_item, "Ring", "pizza"))
query("price_carts", f"""SELECT cart_id, s/100.0::DOUBLE subtotal, {HU('s*9', '100')}/100.0::DOUBLE tax_estimate,
      (s+{HU('s*9', '100')})/100.0::DOUBLE total, 'USD' currency FROM (SELECT guest_order_id cart_id,
      CAST(sum(coalesce({fx('base_price', 100)},0)*quantity) AS BIGINT) s FROM order_item LEFT JOIN menu_item USING (menu_item_id) GROUP BY 1)""")(
    lambda t: carts.price_carts(t.order_item.select(F.col("guest_order_id").alias("cart_id"), "menu_item_id", "quantity"), t.menu_item))
query("price_lines", """SELECT guest_order_id cart_id, menu_item_id, coalesce(item_name,'') item_name, quantity,
      coalesce(round(base_price,2),0.0)::DOUBLE unit_price FROM order_item LEFT JOIN menu_item USING (menu_item_id)""")(
    lambda t: carts.price_lines(t.order_item.select(F.col("guest_order_id").alias("cart_id"), "menu_item_id", "quantity"), t.menu_item))
query("recent_orders", """SELECT profile_id, guest_order_id, placed_at, total_amount, CAST(r AS INTEGER) recency FROM (SELECT *,
      row_number() OVER (PARTITION BY profile_id ORDER BY placed_at DESC, guest_order_id DESC) r FROM guest_order
      WHERE profile_id IS NOT NULL) WHERE r<=5""", ("placed_at",))(lambda t: carts.recent_orders(t.guest_order))
query("occasions", f"""SELECT unit_id, metro_area, CAST(r AS INTEGER) occasion, event_date, event_name, event_category FROM unit JOIN (SELECT *,
      row_number() OVER (PARTITION BY metro_area ORDER BY event_date, event_id) r FROM local_events WHERE event_date>={TODAY})
      USING (metro_area) WHERE r<=5""", ("event_date",))(
    lambda t: carts.occasions(t.unit, t.local_events.filter(F.col("event_date") >= t.today)))
query("occasions_month", """SELECT unit_id, metro_area, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY event_date, event_id) AS INTEGER) occasion,
      event_date, event_name, event_category FROM unit JOIN local_events USING (metro_area) WHERE CAST(event_date AS VARCHAR) LIKE '1995-03%'
      QUALIFY occasion<=5""", ("event_date",))(lambda t: carts.occasions(t.unit, t.local_events, "1995-03"))

# ---- governance
MASK_EMAIL = """CASE WHEN {0} IS NULL THEN NULL WHEN instr({0},'@')>1 THEN left({0},1)||repeat('*',instr({0},'@')-2)||substr({0},instr({0},'@'))
      ELSE '***' END"""
MASK_PHONE = "repeat('*',greatest(0,length(regexp_replace({0},'[^0-9]','','g'))-4))||right(regexp_replace({0},'[^0-9]','','g'),4)"
query("mask_email", f"""SELECT event_id, {MASK_EMAIL.format('address')} masked FROM (SELECT event_id, CASE WHEN event_type='view' THEN '@x'
      WHEN event_type='click' THEN props WHEN event_type<>'error' THEN 'user'||user_id||'@example.com' END address FROM events)""")(
    lambda t: t.raw("events").select("event_id", mask_email(
        F.when(F.col("event_type") == "view", "@x").when(F.col("event_type") == "click", F.col("props")).when(
            F.col("event_type") != "error", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")))
    ).alias("masked")))
query("mask_phone", f"SELECT event_id, {MASK_PHONE.format('props')} masked FROM events")(
    lambda t: t.raw("events").select("event_id", mask_phone(F.col("props")).alias("masked")))
query("tier_to_multiplier", """SELECT loyalty_transaction_id, CASE tier WHEN 'silver' THEN 1.5 WHEN 'gold' THEN 2.0 ELSE 1.0 END::DOUBLE multiplier
      FROM loyalty_transaction""".replace("CASE tier", "(CASE tier").replace("END::", "END)::"))(
    lambda t: t.loyalty_transaction.select("loyalty_transaction_id", tier_to_multiplier(F.col("tier")).alias("multiplier")))
query("mask_by_tag", f"""SELECT guest_profile_id, first_name, last_name, {MASK_EMAIL.format('email')} email, {MASK_PHONE.format('phone')} phone
      FROM guest_profile""")(lambda t: governance.mask_by_tag(t.guest_profile, "guest_profile").select(
          "guest_profile_id", "first_name", "last_name", "email", "phone"))
query("mask_guest_events", f"""SELECT guest_profile_id, created_at event_ts, first_name, {MASK_EMAIL.format('email')} email,
      {MASK_PHONE.format('phone')} phone FROM profile_change""", ("event_ts",))(
    lambda t: governance.mask_by_tag(t.envelope("guest_events").filter(F.col("event_type") == "guest_profile"), "guest_events").select(
        "guest_profile_id", "event_ts", "first_name", "email", "phone"))
GROUPS = ["franchisee_3", "region_2"]
for table, key in (("guest_order", "guest_order_id"), ("waste_log", "waste_log_id"), ("time_punch", "time_punch_id"),
                   ("loyalty_transaction", "loyalty_transaction_id"), ("guest_profile", "guest_profile_id"), ("unit", "unit_id")):
    query(f"row_filter_{table}", f"SELECT {key}, franchisee_id, region_id FROM {table} WHERE franchisee_id=3 OR region_id=2")(
        lambda t, table=table, key=key: governance.visible_to(getattr(t, table), GROUPS).select(key, "franchisee_id", "region_id"))
query("profile_table")(lambda t: governance.profile_table(t.guest_order.select(
    "unit_id", "channel", "member_id", "subtotal", "total_amount", "placed_at")))
query("profile_daily", "SELECT day, column_name, n AS rows, n-c nulls, lo minimum, hi maximum FROM (" + " UNION ALL ".join(
    f"""SELECT CAST(placed_at AS DATE) AS day, '{c}' column_name, count(*) n, count({c}) c, min({c})::DOUBLE lo, max({c})::DOUBLE hi
      FROM guest_order GROUP BY 1""" for c in ("member_id", "total_amount")) + ")", ("day",))(
    lambda t: governance.daily_profile(t.guest_order, ["member_id", "total_amount"], "placed_at"))

ORDER_NUMBERS = ("guest_order_id", "unit_id", "profile_id", "member_id", "subtotal", "discount_amount", "tax_amount", "total_amount")
ORDER_TIMES = ("placed_at", "created_at")
ORDER_TEXTS = ("channel", "order_type", "order_status")
WEEK = "placed_at>=CAST((SELECT max(placed_at) FROM guest_order) AS DATE)-6"
query("profile_week", " UNION ALL ".join(
    f"""SELECT 'guest_order' table_name, '{c}' column_name, count(*) AS rows, count(*)-count({c}) nulls, {lo} low, {hi} high
      FROM guest_order WHERE {WEEK}""" for c in (*ORDER_NUMBERS, *ORDER_TIMES, *ORDER_TEXTS) for lo, hi in [
        (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if c in ORDER_NUMBERS else
        (f"epoch(min({c}))::DOUBLE", f"epoch(max({c}))::DOUBLE") if c in ORDER_TIMES else ("NULL::DOUBLE", "NULL::DOUBLE")]))(
    lambda t: profile_week(t))
STAGED = ("order_events", "inventory_events", "loyalty_events")
query("profile_staging")(lambda t: profile_staging(t))


def profile_week(t):
    """Daily states of all orders, merged over the newest week."""
    store = profile.ProfileStore(t.spark, sinks.fresh(t.spark, "profiles"))
    store.measure(t.guest_order, "guest_order", F.to_date("placed_at"), [*ORDER_NUMBERS, *ORDER_TIMES, *ORDER_TEXTS])
    last = t.guest_order.agg(F.to_date(F.max("placed_at")).alias("d")).first().d
    return store.profile("guest_order", str(last - timedelta(days=6)), str(last)).select(
        "table_name", "column_name", "rows", "nulls", "low", "high")


def profile_staging(t):
    """All columns of the three staging tables, by the day of their events, merged over all days."""
    store = profile.ProfileStore(t.spark, sinks.fresh(t.spark, "profiles"))
    for name in STAGED:
        store.measure(t.envelope(name), name, F.to_date("event_ts"))
    found = [store.profile(name) for name in STAGED]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _pii(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' column_name, '{tag}' AS class, count({c}) AS values, {m} matches, coalesce({m}/nullif(count({c}),0)>=0.5,false) detected
        FROM {table}""" for c in columns for tag, p in governance.PII_PATTERNS.items()
        for m in [f"count(*) FILTER (WHERE regexp_matches({c},'{p}'))"])


query("classify_pii_documents", _pii("documents", ["text", "source", "lang"]))(
    lambda t: governance.classify_pii(t.raw("documents"), ["text", "source", "lang"]))
query("classify_pii_conversations", _pii("conversations", ["text", "role"]))(
    lambda t: governance.classify_pii(t.raw("conversations"), ["text", "role"]))
query("classify_pii_guests", _pii("guest_profile", ["email", "phone", "zip_code", "first_name"]))(
    lambda t: governance.classify_pii(t.guest_profile, ["email", "phone", "zip_code", "first_name"]))
