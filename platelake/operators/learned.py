"""Exact top-n of the whole menu under a learned score, without scoring the whole menu.

Within one request and category the twelve model inputs differ between items only in the popularity at the store.  A tree
ensemble asks that input only at its split values, so between two of them the score is the same: it is worked out once for
each (request, category, popularity interval).  A store's items are numbered by id inside each interval, the unsold ones in
an interval of their own; a request then takes the first items of its best intervals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelake.operators import recommend
from platelake.operators.features import CATEGORIES
from platelake.sources.workspace import lookup, settled

MICRO = recommend.MICRO
QUIET = -1  # the interval of items that the store has not sold
CART = -2  # stands for the items in the cart


@dataclass(frozen=True)
class Split:
    """A node that sends rows with ``feature <= at`` to the left; leaves are plain numbers."""

    feature: str
    at: float
    left: "Split | float"
    right: "Split | float"

    def sql(self, known: dict[str, float] | None = None) -> str:
        """The tree as an expression; splits on features in ``known`` are settled here."""
        if known and self.feature in known:
            side = self.left if known[self.feature] <= self.at else self.right
            return _sql(side, known)
        return f"CASE WHEN {self.feature} <= {_sql(float(self.at))} THEN {_sql(self.left, known)} ELSE {_sql(self.right, known)} END"

    def cuts(self, feature: str) -> set[float]:
        below = [s.cuts(feature) for s in (self.left, self.right) if isinstance(s, Split)]
        return set().union(*below, {float(self.at)} if self.feature == feature else set())


def _sql(side: Split | float, known: dict[str, float] | None = None) -> str:
    return side.sql(known) if isinstance(side, Split) else f"double('{float(side)!r}')"


@dataclass(frozen=True)
class Scorer:
    """``cuts`` are all popularities at which the score can change; ``score`` is that of an item of the given popularity, between
    0 and 1, as an expression of the other model inputs."""

    cuts: tuple[float, ...]
    score: Callable[[float], Column]


def of_trees(trees: list[Split], start: float = 0.0) -> Scorer:
    """The logistic of a sum of trees, as generated expressions: one for each popularity asked for."""
    cuts = set().union(*(t.cuts("store_popularity") for t in trees))

    def score(popularity: float) -> Column:
        margin = F.expr(" + ".join([_sql(start), *(_sql(t, {"store_popularity": popularity}) for t in trees)]))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    return Scorer(tuple(sorted(cuts)), score)


def of_model(model) -> Scorer:
    """A fitted gradient-boosted classifier of :func:`recommend.train_ranker`; its trees are read out, twice the weighted sum of
    their leaves is the margin."""
    def tree(node, weight: float) -> Split | float:
        if node.subtreeDepth() == 0:
            return 2.0 * weight * node.prediction()
        split = node.split()
        return Split(recommend.FEATURES[split.featureIndex()], float(split.threshold()), tree(node.leftChild(), weight),
                     tree(node.rightChild(), weight))

    found = [tree(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return of_trees([t for t in found if isinstance(t, Split)], sum(t for t in found if not isinstance(t, Split)))


def _interval(popularity: Column, cuts: tuple[float, ...]) -> Column:
    """How many cuts lie below the popularity."""
    found = F.lit(0)
    for cut in cuts:
        found = found + (popularity > F.lit(cut)).cast("int")
    return found


def _inside(cuts: tuple[float, ...]) -> list[float]:
    """A popularity in each interval: its upper end, which belongs to it."""
    return [*cuts, (cuts[-1] if cuts else 0.0) + 1.0]


def shelves(popularity: DataFrame, menu: DataFrame, reach: DataFrame, cuts: tuple[float, ...],
            groups: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(cells, places) of the stores in ``reach`` (unit_id, reach); ``groups`` are the suppression groups.

    ``cells``: unit_id, category, sg, interval, items.  ``places``: unit_id, category, sg, interval, depth, menu_item_id in id
    order, the first ``reach`` of each interval and of the unsold items.  Both are lookup tables: their size follows the stores,
    not the menu.
    """
    cell = ["unit_id", "category", "sg"]
    most = reach.agg(F.max("reach")).first()[0] or 0
    shelf, sold = recommend.shop_floor(popularity, menu)
    sold = settled(sold.join(reach.select("unit_id"), "unit_id", "left_semi").withColumn(
        "interval", _interval(F.col("popularity"), cuts)).select(*cell, "interval", "menu_item_id", "place"), "sold_items")
    by_id = Window.partitionBy(*cell, "interval").orderBy("menu_item_id")
    ranked = sold.withColumn("depth", F.row_number().over(by_id)).filter(F.col("depth") <= most).join(
        reach, "unit_id").filter(F.col("depth") <= F.col("reach"))
    counts = settled(sold.groupBy(*cell, "interval").agg(F.count(F.lit(1)).alias("items")), "counts")
    sizes = menu.groupBy("category", "sg").agg(F.count(F.lit(1)).alias("size"))
    taken = counts.groupBy(*cell).agg(F.sum("items").alias("taken"))
    left = lookup(reach.select("*", F.explode(recommend.every_cell(groups)).alias("s")).select("unit_id", "reach", "s.*").join(
        sizes, ["category", "sg"]).join(taken, cell, "left").withColumn(
        "items", F.col("size") - F.coalesce("taken", F.lit(0))).filter("items > 0").select(
        *cell, F.col("reach").alias("want"), "items"), "unsold_cells")
    quiet = left.select(*cell, F.lit(QUIET).alias("interval"), "items")
    unsold = recommend.first_unsold(sold.select(*cell, "place"), shelf, left).select(
        *cell, F.lit(QUIET).alias("interval"), F.col("k").alias("depth"), "menu_item_id")
    places = ranked.select(*cell, "interval", F.col("depth").cast("bigint").alias("depth"), "menu_item_id").unionByName(unsold)
    return counts.unionByName(quiet), lookup(places, "places")


def rank_learned(requests: DataFrame, cart: DataFrame, popularity: DataFrame, menu_item: DataFrame, scorer: Scorer,
                 suppress=recommend.SUPPRESS, max_n: int = recommend.MAX_N) -> DataFrame:
    """Ranked add-ons per request under a learned score; score descending, then id.

    ``requests``: request_id, unit_id, n, tier, aov, store_aov and affinity_* (NULL where unknown).  ``cart``: request_id,
    menu_item_id.  Results are those of scoring every item of the menu that is neither in the cart nor suppressed.

    A request's scores of one category, an array with an entry for each interval, are worked out where the request is, and
    only the store's cells that can matter become rows.
    """
    menu = menu_item.select("menu_item_id", "item_name", "category", "subcategory").withColumn(
        "sg", recommend.suppress_key(F.col("subcategory"), suppress))
    cart = cart.select("request_id", "menu_item_id").distinct()
    zero = F.lit(0.0)
    groups = ("", *suppress)
    lines = recommend.cart_lines(cart, menu, suppress)
    held = cart.groupBy("request_id").agg(F.count(F.lit(1)).alias("held"))
    facts = settled(held.join(recommend.cart_facts(lines, suppress), "request_id", "left"), "cart_facts")
    # Requests without a store share one that has sold nothing.
    unit = F.coalesce(F.col("unit_id").cast("bigint"), F.lit(recommend.NOWHERE))
    deepest = (F.col("n") + F.coalesce("held", F.lit(0))).cast("bigint")
    reach = lookup(requests.select("request_id", unit.alias("unit_id"), recommend.asked_for(max_n).alias("n")).join(
        facts.select("request_id", "held"), "request_id", "left").groupBy("unit_id").agg(F.max(deepest).alias("reach")), "reach")
    cells, places = shelves(popularity, menu, reach, scorer.cuts, groups)
    offered, names = recommend.offered_names(places, menu)
    inside = _inside(scorer.cuts)
    group = F.lit(0)
    for i, name in enumerate(groups):
        group = F.when(F.col("sg") == name, i).otherwise(group)
    at = F.when(F.col("interval") == QUIET, sum(0.0 > cut for cut in scorer.cuts)).otherwise(F.col("interval"))
    stock = lookup(cells.groupBy("unit_id", "category").agg(F.collect_list(F.struct(
        "sg", "interval", "items", group.alias("group"), at.alias("at"))).alias("stock")), "stock")
    tier = F.lit(0.0)
    for name, value in recommend.TIER_ORDINALS.items():
        tier = F.when(F.col("tier") == name, F.lit(float(value))).otherwise(tier)
    head = requests.withColumn("unit_id", unit).join(facts, "request_id", "left").join(
        recommend.held_offers(lines, offered), "request_id", "left")
    head = recommend.carted(head.withColumn("n", recommend.asked_for(max_n)), suppress).withColumns({
        "reach": deepest, "cust_aov": F.coalesce("aov", zero), "store_aov": F.coalesce("store_aov", zero), "tier_ord": tier})
    request = ["request_id", "unit_id", "n", "reach", "tier", "filled", "has_drinks", "anchor"]
    per = head.select(
        *request, "closed", "in_cart", "cust_aov", "store_aov", "tier_ord", F.explode(F.array(*[F.struct(
            F.lit(c).alias("category"), F.col(f"comp_{c}").alias("complement_score"),
            F.coalesce(f"affinity_{c}", zero).alias("cust_cat_affinity")) for c in CATEGORIES])).alias("c")).select(
        *request, "closed", "in_cart", "cust_aov", "store_aov", "tier_ord", "c.*",
        *[F.when(F.col("c.category") == c, 1.0).otherwise(0.0).alias(f"is_cat_{c}") for c in CATEGORIES])
    micro = lambda x: F.greatest(F.lit(0), F.least(F.lit(MICRO), F.round(x * F.lit(float(MICRO))).cast("bigint"))).cast("bigint")
    found = per.select(*request, "closed", "in_cart", "category", "complement_score", F.array(*[micro(scorer.score(v)) for v in inside]).alias(
        "micros")).join(stock, ["unit_id", "category"])
    # A cell below one of its category that has enough items cannot matter.
    is_open = lambda s: ~F.get("closed", s["group"])
    score_of = lambda s: F.get("micros", s["at"])
    enough = F.array_max(F.transform(F.filter("stock", lambda s: is_open(s) & (s["items"] >= F.col("reach"))), score_of))
    # The cart rides along as one more cell.
    here = F.when(F.col("in_cart").isNotNull(), F.array(F.struct(
        F.lit("").alias("sg"), F.lit(CART).alias("interval"), F.lit(0).cast("bigint").alias("items"), F.lit(0).alias("group"), F.lit(0).alias("at"))))
    wanted = found.withColumn("enough", F.coalesce(enough, F.lit(-1))).select(
        *request, "in_cart", "category", "complement_score", "micros", F.explode(F.concat(
            F.filter("stock", lambda s: is_open(s) & (score_of(s) >= F.col("enough"))),
            F.coalesce(here, F.filter("stock", lambda s: F.lit(False))))).alias("cell")).select(
        *request, "category", "complement_score", "cell.sg", "cell.interval", "cell.items",
        (F.col("cell.interval") == CART).alias("is_cart"), F.when(F.col("cell.interval") == CART, F.col("in_cart")).alias("in_cart"),
        F.when(F.col("cell.interval") == CART, -1).otherwise(F.get("micros", F.col("cell.at"))).alias("micro"))
    # Intervals below the score at which enough items are surely found cannot matter.
    above = Window.partitionBy("request_id").orderBy(F.col("micro").desc()).rangeBetween(Window.unboundedPreceding, -1)
    useful = wanted.withColumn("better", F.coalesce(F.sum("items").over(above), F.lit(0))).filter(
        F.col("is_cart") | (F.col("better") < F.col("reach")))
    upto = F.sequence(F.lit(1).cast("bigint"), F.least("items", "reach"))
    at = useful.withColumn("at", F.explode(F.when(F.col("is_cart"), F.col("in_cart")).otherwise(upto))).drop("in_cart")
    pairs = at.withColumn("depth", F.when(~F.col("is_cart"), F.col("at"))).join(
        places, ["unit_id", "category", "sg", "interval", "depth"], "left").withColumn(
        "menu_item_id", F.when(F.col("is_cart"), F.col("at")).otherwise(F.col("menu_item_id"))).filter(F.col("menu_item_id").isNotNull())
    best = Window.partitionBy("request_id").orderBy(F.col("micro").desc(), "menu_item_id")
    top = recommend.without_cart(pairs).withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= max_n).filter("rank <= n")
    reason = recommend.reco_reason(F.col("category"), F.col("filled"), F.col("complement_score"), F.col("anchor"),
                                   F.col("has_drinks"), F.col("tier"))
    return top.withColumn("reason", reason).join(names, "menu_item_id").select(
        "request_id", "rank", "menu_item_id", "item_name", "category", "subcategory",
        (F.col("micro") / F.lit(float(MICRO))).alias("score"), "reason")
