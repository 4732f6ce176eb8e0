"""Add-on recommendations in batch.

A cart is a table of (request_id, menu_item_id) rows; only those of its items
that some store offers are gathered per request, and requests never meet the
whole menu.  Within one store and
category the blended score depends on the item only through its popularity, so
the best ``n`` items of a request are among the first ``n`` plus
items-in-cart of that store's popularity order.  Only those are generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelake.functions.ids import make_id
from platelake.functions.numeric import clamp, fixed, half_up
from platelake.operators.features import CATEGORIES
from platelake.operators.joins import left_join
from platelake.sources.workspace import lookup, settled

# Complement weight of the inner category when the basket holds the outer.
COMPLEMENTS = {
    "pizza": {"drinks": 0.9, "sides": 0.7, "desserts": 0.5, "wings": 0.4, "salads": 0.2},
    "wings": {"drinks": 0.8, "sides": 0.8, "desserts": 0.3, "pizza": 0.4, "salads": 0.2},
    "sides": {"drinks": 0.7, "pizza": 0.4, "desserts": 0.3, "wings": 0.3, "salads": 0.1},
    "salads": {"drinks": 0.7, "pizza": 0.3, "sides": 0.2, "desserts": 0.2, "wings": 0.1},
    "drinks": {"pizza": 0.3, "desserts": 0.4, "sides": 0.3, "wings": 0.2, "salads": 0.1},
    "desserts": {"drinks": 0.6, "pizza": 0.2, "sides": 0.1, "wings": 0.1, "salads": 0.1},
}

# Subcategories not recommended twice, tier ordinals, result bounds.
SUPPRESS = ("soda", "water", "pepperoni", "cheese", "boneless", "traditional")
TIER_ORDINALS = {"none": 0, "bronze": 1, "silver": 2, "gold": 3, "platinum": 4}
DEFAULT_N, MAX_N = 5, 10

# Scores are rounded to millionths, so popularities closer than this many may tie.
MICRO = 1_000_000
TIE_MARGIN = 10


def basket_flags(cart: DataFrame, menu_item: DataFrame) -> DataFrame:
    """Per request one boolean per category in the cart, and the sorted category list."""
    known = cart.join(menu_item.select("menu_item_id", "category"), "menu_item_id")
    flags = known.groupBy("request_id").agg(
        *[F.coalesce(F.bool_or(F.col("category") == c), F.lit(False)).alias(f"has_{c}") for c in CATEGORIES])
    present = F.filter(F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in sorted(CATEGORIES)]),
                       lambda c: c.isNotNull())
    return flags.withColumn("cart_categories", present)


def complement_score(candidate: str) -> Column:
    """Strongest complement weight of ``candidate`` over the basket's categories."""
    weights = [F.when(F.col(f"has_{b}"), F.lit(w[candidate])).otherwise(0.0)
               for b, w in COMPLEMENTS.items() if candidate in w]
    return clamp(F.greatest(F.lit(0.0), *weights), 0.0, 1.0)


def has_basket() -> Column:
    out = F.lit(False)
    for c in CATEGORIES:
        out = out | F.col(f"has_{c}")
    return out


def heuristic_score(filled: Column, complement: Column, affinity: Column, popularity: Column) -> Column:
    """Blend in [0, 1], rounded half up to six decimals.

    The parts have at most six decimals, so the blend is taken on whole
    millionths: equal candidates stay equal however their doubles round.
    """
    c, a, p = (fixed(x, MICRO) for x in (complement, affinity, popularity))
    hundredths = F.when(filled, 55 * c + 25 * a + 20 * p).otherwise(55 * a + 45 * p)
    return clamp(half_up(hundredths, F.lit(100)) / F.lit(float(MICRO)), 0.0, 1.0)


def reco_reason(category: Column, filled: Column, complement: Column, anchor: Column, has_drinks: Column,
                tier: Column) -> Column:
    base = (F.when((complement >= 0.5) & filled, F.concat(F.lit("complements "), anchor))
            .when(~filled, "popular at this store").otherwise("frequently added"))
    base = F.when((category == "drinks") & filled & ~has_drinks,
                  "complements your order; no drink in cart").otherwise(base)
    return F.when(tier.isin("gold", "platinum"), F.concat(base, F.lit("; "), tier, F.lit("-tier favorite"))).otherwise(base)


def suppress_key(subcategory: Column, suppress) -> Column:
    return F.when(subcategory.isin(*suppress), subcategory).otherwise(F.lit("")) if suppress else F.lit("")


def suppressed(cart: DataFrame, menu_item: DataFrame, suppress=SUPPRESS) -> DataFrame:
    """(request_id, subcategory) pairs that must not be offered again."""
    return cart.join(menu_item.select("menu_item_id", "subcategory"), "menu_item_id").filter(
        F.col("subcategory").isin(*suppress)).select("request_id", "subcategory").distinct()


def numbered(rows: DataFrame, by: tuple[str, ...] = (), width: int = 65_536, name: str = "slot") -> DataFrame:
    """Add 0, 1, 2, ... in ``menu_item_id`` order within each ``by`` group.

    Ids are ranked inside fixed id ranges, which hold at most ``width`` ids each,
    and shifted by the sizes of the group's earlier ranges.  No task sorts a whole
    group, however many items share it.
    """
    key = [*by, "id_range"]
    ranged = rows.withColumn("id_range", F.floor(F.col("menu_item_id") / width))
    earlier = Window.partitionBy(*by).orderBy("id_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).select(
        *key, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("id_offset"))
    inside = Window.partitionBy(*key).orderBy("menu_item_id")
    return ranged.withColumn("id_rank", F.row_number().over(inside)).join(offsets, key).withColumn(
        name, F.col("id_offset") + F.col("id_rank") - 1).drop("id_range", "id_rank", "id_offset")


NOWHERE = -(1 << 63)  # the store of requests without one


def shop_floor(popularity: DataFrame, menu: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shelf, sold): the menu numbered by id within category and suppression group, and what each store has sold of it."""
    shelf = numbered(menu.select("category", "sg", "menu_item_id"), ("category", "sg"), name="place").withColumn(
        "place", F.col("place") + 1)
    sold = popularity.filter(F.col("popularity") > 0).select("unit_id", "menu_item_id", "popularity").join(shelf, "menu_item_id")
    return shelf, sold


def first_unsold(sold: DataFrame, shelf: DataFrame, want: DataFrame) -> DataFrame:
    """unit_id, category, sg, k, menu_item_id: the first unsold items by id of the cells in ``want``.

    ``want``: unit_id, category, sg, want (how many), items (the most there can be).  ``sold`` has the place of every sold item
    of these cells.  The k-th unsold item stands on place k plus the number of sold items with fewer than k unsold ones before
    them, so no store meets the whole menu.
    """
    cell = ["unit_id", "category", "sg"]
    most = want.agg(F.max("want")).first()[0] or 0
    by_place = sold.select(*cell, "place", F.col("place").alias("menu_item_id"))
    before = numbered(by_place, tuple(cell), name="nth").withColumn("free", F.col("place") - F.col("nth") - 1)
    # Only sold items with fewer than ``want`` unsold ones before them can move a wanted place.
    moved = before.filter(F.col("free") < most).join(want.select(*cell, "want"), cell).filter(
        F.col("free") < F.col("want")).groupBy(*cell, "free").agg(F.count(F.lit(1)).alias("n"))
    steps = want.select(*cell, F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("want", "items"))).alias("k"))
    shift = Window.partitionBy(*cell).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    shifted = steps.join(moved.select(*cell, (F.col("free") + 1).alias("k"), "n"), [*cell, "k"], "left").withColumn(
        "place", F.col("k") + F.coalesce(F.sum("n").over(shift), F.lit(0)))
    return shifted.join(shelf, ["category", "sg", "place"]).select(*cell, "k", "menu_item_id")


def every_cell(groups) -> Column:
    """All pairs of a category and a suppression group."""
    return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(g).alias("sg")) for c in CATEGORIES for g in groups])


def popularity_pools(popularity: DataFrame, menu: DataFrame, reach: DataFrame, groups) -> tuple[DataFrame, DataFrame]:
    """(pool, slots) of the stores in ``reach`` (unit_id, reach: the deepest place that a request there can take).

    ``pool``: unit_id, category, sg, depth, menu_item_id, micro.  Depth counts items that are surely better plus equally
    popular ones with a lower id, so rounding of the final score cannot push an item past it; unsold items follow in id order.
    ``slots``: unit_id, category, sg, sold, best.  Both are lookup tables: their size follows the stores, not the menu.
    """
    cell = ["unit_id", "category", "sg"]
    most = reach.agg(F.max("reach")).first()[0] or 0
    shelf, sold = shop_floor(popularity, menu)
    items = settled(sold.join(reach.select("unit_id"), "unit_id", "left_semi").filter(F.col("category").isin(*CATEGORIES)).select(
        *cell, "menu_item_id", "place", fixed("popularity", MICRO).alias("micro")), "sold_items")
    # Count per distinct popularity first: the running count then walks distinct values only.
    surely = Window.partitionBy(*cell).orderBy(F.col("micro").desc()).rangeBetween(Window.unboundedPreceding, -TIE_MARGIN - 1)
    levels = settled(items.groupBy(*cell, "micro").agg(F.count(F.lit(1)).alias("level_size")).withColumn(
        "better", F.coalesce(F.sum("level_size").over(surely), F.lit(0))), "levels")
    near = lookup(levels.join(reach, "unit_id").filter(F.col("better") < F.col("reach")).select(
        *cell, "micro", "better", "reach"), "near_levels")
    equals = Window.partitionBy(*cell, "micro").orderBy("menu_item_id")
    popular = items.join(near, [*cell, "micro"]).withColumn("equals", F.row_number().over(equals)).filter(
        F.col("equals") <= most).withColumn("depth", F.col("better") + F.col("equals")).filter(F.col("depth") <= F.col("reach"))
    slots = lookup(levels.groupBy(*cell).agg(F.sum("level_size").alias("sold"), F.max("micro").alias("best")), "slots")
    # Unsold items are needed only where the sold ones may not suffice.
    sizes = menu.groupBy("category", "sg").agg(F.count(F.lit(1)).alias("size"))
    short = lookup(reach.select("*", F.explode(every_cell(groups)).alias("s")).select("unit_id", "reach", "s.*").join(
        slots.select(*cell, "sold"), cell, "left").withColumn("sold", F.coalesce("sold", F.lit(0))).filter(
        F.col("sold") < F.col("reach")).join(sizes, ["category", "sg"]).select(
        *cell, F.col("reach").alias("want"), F.col("size").alias("items")), "short_slots")
    taken = items.join(short, cell, "left_semi").select(*cell, "place").distinct()
    quiet = first_unsold(taken, shelf, short)
    return lookup(popular.select(*cell, "depth", "menu_item_id", "micro").unionByName(quiet.select(
        *cell, F.col("k").alias("depth"), "menu_item_id", F.lit(0).cast("bigint").alias("micro"))), "pool"), slots


def cart_lines(cart: DataFrame, menu: DataFrame, suppress) -> DataFrame:
    """Distinct cart items that the menu has, stored: request_id, menu_item_id, code (of category and suppression group)."""
    category, sg = F.lit(len(CATEGORIES)), F.lit(0)
    for i, c in enumerate(CATEGORIES):
        category = F.when(F.col("category") == c, i).otherwise(category)
    for i, s in enumerate(suppress):
        sg = F.when(F.col("sg") == s, i + 1).otherwise(sg)
    code = (category * (len(suppress) + 1) + sg).cast("short")
    return settled(cart.select("request_id", "menu_item_id").distinct().join(
        menu.select("menu_item_id", code.alias("code")), "menu_item_id").select("request_id", "menu_item_id", "code"), "cart")


def cart_facts(lines: DataFrame, suppress) -> DataFrame:
    """Per request: unrestricted items held per category, subcategories present, complement scores and the anchor.

    The narrow rows are dealt out by request before they are added up.
    """
    kinds = len(suppress) + 1
    of = lambda i: F.col("code").between(i * kinds, (i + 1) * kinds - 1)
    held, blocks = [f"held_{c}" for c in CATEGORIES], [f"block_{i}" for i in range(len(suppress))]
    found = lines.select("request_id", "code").repartition("request_id").groupBy("request_id").agg(
        *[F.bool_or(of(i)).alias(f"has_{c}") for i, c in enumerate(CATEGORIES)],
        *[F.count_if(F.col("code") == i * kinds).alias(h) for i, h in enumerate(held)],
        *[F.bool_or(F.col("code") % kinds == i + 1).alias(b) for i, b in enumerate(blocks)])
    return found.select(
        "request_id", *held, *blocks, has_basket().alias("filled"), "has_drinks",
        F.coalesce(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in sorted(CATEGORIES)]).alias("anchor"),
        *[complement_score(c).alias(f"comp_{c}") for c in CATEGORIES])


def carted(head: DataFrame, suppress) -> DataFrame:
    """Cart facts of requests without a known item."""
    no, zero, none = F.lit(False), F.lit(0).cast("bigint"), F.lit(0.0)
    return head.withColumns({
        "filled": F.coalesce("filled", no), "has_drinks": F.coalesce("has_drinks", no),
        **{f"held_{c}": F.coalesce(f"held_{c}", zero) for c in CATEGORIES},
        **{f"comp_{c}": F.coalesce(f"comp_{c}", none) for c in CATEGORIES},
        "closed": F.array(no, *[F.coalesce(f"block_{i}", no) for i in range(len(suppress))])})


def held_offers(lines: DataFrame, offered: DataFrame) -> DataFrame:
    """request_id, in_cart: the cart items that some store offers; no others can be candidates."""
    return lines.join(offered, "menu_item_id", "left_semi").select("request_id", "menu_item_id").repartition(
        "request_id").groupBy("request_id").agg(F.collect_list("menu_item_id").alias("in_cart"))


def without_cart(rows: DataFrame) -> DataFrame:
    """Candidates that are not in their request's cart; ``is_cart`` marks the rows of cart items among them.

    Both kinds of rows come from the request's own row, so they are where the request is and nothing is dealt out again.
    """
    same = Window.partitionBy("request_id", "menu_item_id")
    return rows.withColumn("held", F.max("is_cart").over(same)).filter(
        ~F.col("is_cart") & ~(F.col("held") & F.col("request_id").isNotNull())).drop("held", "is_cart")


def asked_for(max_n: int) -> Column:
    return F.least(F.lit(max_n), F.greatest(F.lit(1), F.coalesce("n", F.lit(DEFAULT_N))))


def offered_names(pool: DataFrame, menu: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, names) of all items in a pool, as lookup tables."""
    ids = lookup(pool.select("menu_item_id").distinct(), "offered")
    names = menu.select("menu_item_id", "item_name", "subcategory").join(ids, "menu_item_id", "left_semi")
    return ids, lookup(names, "offered_names")


def rank_recommendations(requests: DataFrame, cart: DataFrame, popularity: DataFrame, menu_item: DataFrame,
                         suppress=SUPPRESS, max_n: int = MAX_N) -> DataFrame:
    """Ranked add-ons per request.

    ``requests``: request_id, unit_id, n, tier and affinity_* (NULL for a cold
    start).  ``cart``: request_id, menu_item_id.  Items in the cart and doubled
    subcategories are left out; score descending, then id.  ``n`` is held between
    1 and ``max_n``.

    A slot is one category and suppression group.  The n-th best item of any
    category bounds the answer from below, so slots and depths that cannot reach
    the bound are dropped before any item is joined.  A suppression group that
    the cart touches is closed, so only unrestricted slots hold cart items.

    What a store can offer is cut to the depth that its requests can reach and
    stored first.  Requests are dealt out once, by their id; slots, candidates
    and ranks are then worked out where they are.
    """
    menu = menu_item.select("menu_item_id", "item_name", "category", "subcategory").withColumn(
        "sg", suppress_key(F.col("subcategory"), suppress))
    zero, groups = F.lit(0).cast("bigint"), ("", *suppress)
    lines = cart_lines(cart, menu, suppress)
    facts = settled(cart_facts(lines, suppress), "cart_facts")
    unit = F.coalesce(F.col("unit_id").cast("bigint"), F.lit(NOWHERE))
    held = F.greatest(*[F.coalesce(f"held_{c}", zero) for c in CATEGORIES])
    reach = lookup(requests.select("request_id", unit.alias("unit_id"), asked_for(max_n).alias("n")).join(
        facts, "request_id", "left").groupBy("unit_id").agg(F.max(F.col("n") + held).alias("reach")), "reach")
    pool, slots = popularity_pools(popularity, menu, reach, groups)
    of = lambda c, s: F.max(F.when((F.col("category") == c) & (F.col("sg") == s), F.col("best")))
    bests = slots.groupBy("unit_id").agg(*[F.array(*[F.coalesce(of(c, s), zero) for s in groups]).alias(f"best_{c}") for c in CATEGORIES])
    tops = pool.filter(F.col("sg") == "").groupBy("unit_id").agg(*[F.sort_array(F.collect_list(
        F.when(F.col("category") == c, F.col("micro"))), asc=False).alias(f"tops_{c}") for c in CATEGORIES])
    units = lookup(reach.select("unit_id").join(bests, "unit_id", "left").join(tops, "unit_id", "left"), "units")
    offered, names = offered_names(pool, menu)
    head = requests.withColumn("unit_id", unit).join(facts, "request_id", "left").join(
        held_offers(lines, offered), "request_id", "left").join(units, "unit_id", "left").withColumns({
        "n": asked_for(max_n), **{f"liked_{c}": fixed(F.coalesce(f"affinity_{c}", F.lit(0.0)), MICRO) for c in CATEGORIES}})
    head = carted(head, suppress)
    filled = F.col("filled")
    # The request's part of a score, in hundredths of a millionth.
    head = head.withColumns({
        "weight": F.when(filled, 20).otherwise(45).cast("bigint"),
        **{f"base_{c}": F.when(filled, 55 * fixed(f"comp_{c}", MICRO) + 25 * F.col(f"liked_{c}")).otherwise(
            55 * F.col(f"liked_{c}")) for c in CATEGORIES}})
    nth = [F.col(f"base_{c}") + F.col("weight") * F.get(f"tops_{c}", (F.col("n") + F.col(f"held_{c}") - 1).cast("int"))
           for c in CATEGORIES]
    bound = F.coalesce(F.greatest(*nth), F.lit(-1))
    # Categories first, then suppression groups: one array of all slots makes methods that the JVM does not compile.
    kind = F.array(*[F.struct(
        F.lit(c).alias("category"), F.col(f"comp_{c}").alias("complement"), F.col(f"base_{c}").alias("base"),
        F.col(f"liked_{c}").alias("liked"), F.col(f"held_{c}").alias("held"), F.col(f"best_{c}").alias("bests")) for c in CATEGORIES])
    group = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("sg")) for i, s in enumerate(groups)])
    # A rounded score may reach a bound that the exact one misses by less than a millionth.
    reaches = lambda part: part + F.lit(100) >= F.col("bound")
    keep = ["request_id", "unit_id", "n", "tier", "filled", "has_drinks", "anchor", "weight", "bound"]
    kinds = head.withColumn("bound", bound).select(
        *keep, "closed", "in_cart", F.explode(kind).alias("k")).select(*keep, "closed", "in_cart", "k.*")
    # The cart rides along as one more group of the first category.
    here = F.when((F.col("category") == CATEGORIES[0]) & F.col("in_cart").isNotNull(), F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("sg"))))
    cells = kinds.withColumn("g", F.explode(F.concat(group, F.coalesce(here, F.array().cast("array<struct<i:int,sg:string>>"))))).withColumns({
        "is_cart": F.col("g.i") < 0, "sg": F.col("g.sg")})
    open_slots = cells.filter(F.col("is_cart") | (~F.get("closed", F.col("g.i")) & reaches(
        F.col("base") + F.col("weight") * F.coalesce(F.get("bests", F.col("g.i")), zero))))
    upto = F.sequence(F.lit(1).cast("bigint"), (F.col("n") + F.when(F.col("g.i") == 0, F.col("held")).otherwise(zero)).cast("bigint"))
    at = open_slots.withColumn("at", F.explode(F.when(F.col("is_cart"), F.col("in_cart")).otherwise(upto))).drop("in_cart", "bests", "closed", "g")
    depth = F.when(~F.col("is_cart"), F.col("at")).alias("depth")
    pairs = at.withColumn("depth", depth).join(pool, ["unit_id", "category", "sg", "depth"], "left").filter(
        F.col("is_cart") | (F.col("menu_item_id").isNotNull() & reaches(F.col("base") + F.col("weight") * F.col("micro")))).select(
        "request_id", "n", "tier", "filled", "has_drinks", "anchor", "category", "complement", "liked", "is_cart",
        F.when(F.col("is_cart"), F.col("at")).otherwise(F.col("menu_item_id")).alias("menu_item_id"), "micro")
    part = lambda c: F.col(c) / F.lit(float(MICRO))
    scored = without_cart(pairs).withColumn(
        "score", heuristic_score(F.col("filled"), F.col("complement"), part("liked"), part("micro")))
    first = Window.partitionBy("request_id").orderBy(F.col("score").desc(), "menu_item_id")
    top = scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= max_n).filter("rank <= n")
    reason = reco_reason(F.col("category"), F.col("filled"), F.col("complement"), F.col("anchor"), F.col("has_drinks"),
                         F.col("tier"))
    return top.withColumn("reason", reason).join(names, "menu_item_id").select(
        "request_id", "rank", "menu_item_id", "item_name", "category", "subcategory", "score", "reason")


# ---- learned ranker

FEATURES = ("complement_score", "cust_cat_affinity", "store_popularity", "cust_aov", "store_aov", "tier_ord",
            *[f"is_cat_{c}" for c in CATEGORIES])


def feature_columns(pairs: DataFrame, cart: DataFrame, customers: DataFrame, stores: DataFrame,
                    popularity: DataFrame, menu_item: DataFrame) -> DataFrame:
    """The twelve model inputs of each (request_id, menu_item_id, profile_id, unit_id, ...) pair."""
    # Stored while the rows are narrow: the wide ones are dealt out by request and by guest only.
    flags = settled(basket_flags(cart, menu_item).drop("cart_categories"), "basket_flags")
    narrow = settled(
        pairs.join(menu_item.select("menu_item_id", "category"), "menu_item_id")
        .join(popularity.select("unit_id", "menu_item_id", "popularity"), ["unit_id", "menu_item_id"], "left"), "pairs")
    rows = (
        narrow.join(flags, "request_id", "left")
        .transform(left_join, customers.select("profile_id", "tier", "aov", *[f"affinity_{c}" for c in CATEGORIES]), "profile_id")
        .join(stores.select("unit_id", "store_aov"), "unit_id", "left")
        .withColumns({f"has_{c}": F.coalesce(f"has_{c}", F.lit(False)) for c in CATEGORIES}))
    cat = F.col("category")
    comp, aff = F.lit(0.0), F.lit(0.0)
    for c in CATEGORIES:
        comp = F.when(cat == c, complement_score(c)).otherwise(comp)
        aff = F.when(cat == c, F.coalesce(f"affinity_{c}", F.lit(0.0))).otherwise(aff)
    tier = F.lit(0.0)
    for name, value in TIER_ORDINALS.items():
        tier = F.when(F.col("tier") == name, F.lit(float(value))).otherwise(tier)
    zero = F.lit(0.0)
    return rows.select(
        *pairs.columns, comp.alias("complement_score"), aff.alias("cust_cat_affinity"),
        F.coalesce("popularity", zero).alias("store_popularity"), F.coalesce("aov", zero).alias("cust_aov"),
        F.coalesce("store_aov", zero).alias("store_aov"), tier.alias("tier_ord"),
        *[F.when(cat == c, 1.0).otherwise(0.0).alias(f"is_cat_{c}") for c in CATEGORIES])


def held_out(order_item: DataFrame) -> DataFrame:
    """Last line of every order with at least two lines."""
    return order_item.groupBy("guest_order_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max_by(F.struct("order_item_id", "menu_item_id"), "order_item_id").alias("held")).filter("lines >= 2").select(
        "guest_order_id", F.col("held.order_item_id").alias("order_item_id"),
        F.col("held.menu_item_id").alias("menu_item_id"))


def negative_items(order_item: DataFrame, orders: DataFrame, catalogue: DataFrame, per_order: int = 3) -> DataFrame:
    """``per_order`` items per order that the order does not hold.

    ``catalogue`` numbers the menu 0..size-1 (slot, menu_item_id).  Each order
    starts at a hashed slot and walks on; as it can meet at most its own distinct
    items, ``per_order`` plus that many steps always suffice, so no pairing with
    the whole menu is needed.  All orders take their first ``per_order`` steps;
    only those that met an item of their own walk on, long walks in pieces that
    spread.
    """
    size = catalogue.agg(F.count(F.lit(1))).first()[0]
    held = settled(order_item.select("guest_order_id", "menu_item_id").distinct(), "held_items")
    steps = settled(orders.select("guest_order_id").join(held.groupBy("guest_order_id").agg(
        F.count(F.lit(1)).alias("distinct_items")), "guest_order_id").select(
        "guest_order_id", F.least(F.col("distinct_items") + per_order, F.lit(size)).alias("reach")), "walks")

    def free(walk: DataFrame) -> DataFrame:
        slot = F.pmod(make_id("neg", F.col("guest_order_id")) + F.col("step"), F.lit(size))
        return walk.withColumn("slot", slot).join(catalogue, "slot").join(held, ["guest_order_id", "menu_item_id"], "left_anti").select(
            "guest_order_id", "menu_item_id", "step")

    span = lambda lo, hi, by: F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"), F.lit(by).cast("bigint")))
    first = settled(free(steps.filter("reach > 0").select(
        "guest_order_id", span(F.lit(0), F.least(F.lit(per_order), F.col("reach")) - 1, 1).alias("step"))), "first_steps")
    found = first.groupBy("guest_order_id").agg(F.count(F.lit(1)).alias("found"))
    short = steps.filter(F.col("reach") > per_order).join(found, "guest_order_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(0))).filter(F.col("found") < per_order)
    short = settled(short, "short_walks")
    pieces = short.select("guest_order_id", "reach", span(F.lit(per_order), F.col("reach") - 1, 1024).alias("lo"))
    walk = pieces.select("guest_order_id", span(F.col("lo"), F.least(F.col("lo") + 1023, F.col("reach") - 1), 1).alias("step"))
    nth = Window.partitionBy("guest_order_id").orderBy("step")
    more = free(walk).withColumn("k", F.row_number().over(nth)).filter(F.col("k") <= per_order).join(
        short.select("guest_order_id", "found"), "guest_order_id").filter(F.col("k") <= per_order - F.col("found"))
    return first.select("guest_order_id", "menu_item_id").unionByName(more.select("guest_order_id", "menu_item_id"))


def training_set(guest_order, order_item, customers, stores, popularity, menu_item, catalogue=None) -> DataFrame:
    """Label 1: the held-out last item; label 0: three items not in the order."""
    lines = settled(order_item.select("guest_order_id", "order_item_id", "menu_item_id"), "order_lines")
    held = settled(held_out(lines), "held_out")
    # A line is held out of its own order, so the lines meet by order.
    asked = held.select("guest_order_id", F.col("order_item_id").alias("held_id"))
    basket = lines.join(asked, "guest_order_id").filter(~F.coalesce(F.col("order_item_id") == F.col("held_id"), F.lit(False))).select(
        F.col("guest_order_id").alias("request_id"), "menu_item_id")
    catalogue = numbered(menu_item.select("menu_item_id")) if catalogue is None else catalogue
    pos = held.select("guest_order_id", "menu_item_id", F.lit(1.0).alias("label"))
    neg = negative_items(lines, held, catalogue).withColumn("label", F.lit(0.0))
    pairs = pos.unionByName(neg).join(guest_order.select("guest_order_id", "profile_id", "unit_id"), "guest_order_id")
    pairs = pairs.withColumnRenamed("guest_order_id", "request_id")
    return feature_columns(pairs, basket, customers, stores, popularity, menu_item)


def vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train_ranker(training: DataFrame, trees: int = 100, depth: int = 3, seed: int = 42):
    """Gradient-boosted trees over the training rows."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features",
                         labelCol="label").fit(vectors(training))


def learned_scores(model, rows: DataFrame) -> DataFrame:
    """Probability that the item is added."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(vectors(rows))
    return out.withColumn("score", F.round(vector_to_array("probability")[1], 6)).drop(
        "features", "rawPrediction", "probability")


# ---- batch scoring contract

def _present(c: str) -> Column:
    col = F.col(c)
    return col.isNotNull() & ~F.isnan(col.try_cast("double")) if c != "tier" else col.isNotNull()


def parse_cart(raw: Column) -> Column:
    """JSON array or comma list of ids; anything missing is an empty cart."""
    as_json = F.from_json(raw, "array<bigint>")
    parts = F.filter(F.split(raw, ","), lambda p: p != "")
    as_list = F.transform(parts, lambda p: F.trim(p).try_cast("bigint"))
    ids = F.when(F.trim(raw).startswith("["), as_json).otherwise(as_list)
    return F.filter(F.coalesce(ids, F.array().cast("array<bigint>")), lambda i: i.isNotNull())


def _whole(field: str) -> Column:
    """A request field as BIGINT; NULL, NaN and anything else that is no whole number in range is NULL."""
    return F.col(field).cast("string").try_cast("double").try_cast("bigint")


def is_personalized() -> Column:
    """Whether a request carries a tier or an affinity."""
    known = F.coalesce(~F.col("tier").isin("", "none"), F.lit(False))
    for c in CATEGORIES:
        known = known | _present(f"affinity_{c}")
    return known


def score_batch(requests: DataFrame, popularity: DataFrame, menu_item: DataFrame, suppress=SUPPRESS, scorer=None,
                max_n: int = MAX_N) -> DataFrame:
    """Enriched requests -> ranked rows plus whether the request was personalised.

    Reads ``cart_product_ids`` (text), ``viewed_product_id``,
    ``num_recommendations``, ``store_id`` and the looked-up customer features.
    NULL and NaN both mean missing; the viewed item joins the cart.  With a
    ``scorer`` (see ``learned``) the learned score ranks, and ``aov`` and
    ``store_aov`` are read too; without one the blended score does.
    """
    affinities = [f"affinity_{c}" for c in CATEGORIES]
    clean = requests.withColumn("personalized", is_personalized()).withColumns(
        {a: F.when(_present(a), F.col(a)) for a in affinities})
    viewed = _whole("viewed_product_id")
    ids = F.concat(parse_cart(F.col("cart_product_ids")),
                   F.when(viewed.isNotNull() & (viewed != 0), F.array(viewed))
                   .otherwise(F.array().cast("array<bigint>")))
    money = {"aov": F.col("personalized"), "store_aov": F.lit(True)}
    # Stored, as requests with their lookups are read for carts, heads and results.
    clean = settled(clean.select(
        "request_id", _whole("store_id").alias("unit_id"), _whole("num_recommendations").alias("n"),
        F.when(F.col("personalized"), F.col("tier")).alias("tier"), *affinities, "personalized", ids.alias("ids"),
        *[F.when(known & _present(c), F.col(c)).alias(c) for c, known in money.items() if scorer is not None]), "requests")
    cart = clean.select("request_id", F.explode("ids").alias("menu_item_id"))
    head = clean.drop("ids", "personalized")
    if scorer is None:
        ranked = rank_recommendations(head, cart, popularity, menu_item, suppress, max_n)
    else:
        from platelake.operators.learned import rank_learned

        ranked = rank_learned(head, cart, popularity, menu_item, scorer, suppress, max_n)
    return ranked.join(clean.select("request_id", "personalized"), "request_id")


def as_lists(ranked: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """One row per request with its recommendations in order.

    With ``requests`` (request_id, personalized) a request for which nothing is left has an empty list.
    """
    item = F.struct("rank", "menu_item_id", "item_name", "category", "subcategory", "score", "reason")
    lists = ranked.groupBy("request_id", "personalized").agg(F.array_sort(F.collect_list(item)).alias("recommendations"))
    if requests is None:
        return lists
    return requests.select("request_id", "personalized").join(lists.drop("personalized"), "request_id", "left").withColumn(
        "recommendations", F.coalesce("recommendations", F.array()))


def score_lists(requests: DataFrame, popularity: DataFrame, menu_item: DataFrame, suppress=SUPPRESS, scorer=None,
                max_n: int = MAX_N) -> DataFrame:
    """``score_batch`` as one row for every request; where nothing is left to recommend the list is empty."""
    ranked = score_batch(requests, popularity, menu_item, suppress, scorer, max_n)
    return as_lists(ranked, requests.withColumn("personalized", is_personalized()))
