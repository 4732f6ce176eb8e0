"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Each source's token target comes from its weight: shares of ``mass`` times all tokens, no target above ``most`` times the
source, the excess shared again by weight (a water level, found from prefix sums over the sources).  The document rates
nearest to 1 in relative entropy that meet a source's target under the limit ``most`` are exponentially tilted,
``rate = least(most, exp(lambda * size / mean size))``.  Lambda solves the convex dual by Newton steps; every step is a
distributed sum over the (source, size) histogram of the documents, with a bracket that falls back to halving.  Rates are
rounded into copies by a hash of the id, and the rounding error of a source is repaired by adding or taking away single
copies of a few documents of each size class, largest first.

Sources are numbered by a window over the table of sources, which has one row for each source.

Defined cases: NULL sources are one source, the last one; a NULL or empty text has size 0, rate 0 and no copy; a source
without words has target 0.  Every row is rounded on its own, those that share an id, have none or
are equal included; among equal rows the place in the table decides.  Reruns over the same files give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platelake.sources.workspace import stored

WEIGHTS = (3, 1, 2)
MASS, MOST = 1.5, 2.0
STEPS = 40
REPAIRS = 64


def targets(sizes: DataFrame, weights: tuple[float, ...], mass: float, most: float) -> DataFrame:
    """source, source_size, target for each source of (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1))
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    # Sources fill up in the order of full / weight; below the level a source is full, above it gets level * weight.
    by = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = ((F.lit(float(mass)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    per = per.withColumn("level", level)
    # The level rises while full sources are taken out and falls once open ones are: its largest value is the water level.
    top = F.max("level").over(everything)
    return per.withColumn("top", top).select("source", "source_size", "rows",
                                             F.least("full", F.col("top") * F.col("weight")).alias("target"))


def tilt(size: Column, lam: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def balanced(sizes: DataFrame, wanted: DataFrame, most: float, steps: int = STEPS) -> DataFrame:
    """source, source_size, target, mean, lam: the tilt of each source."""
    cells = stored(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-cells")
    state = wanted.filter("source_size > 0").withColumns({
        "mean": F.col("source_size") / F.col("rows"), "lam": F.lit(0.0), "lo": F.lit(-1e4), "hi": F.lit(1e4),
        "done": F.col("target") >= F.col("source_size") * F.lit(most)})
    state = stored(state.withColumn("lam", F.when(F.col("done"), F.lit(1e4)).otherwise(F.col("lam"))), "mixing-state")
    key = cells["source"].eqNullSafe(F.col("s.source"))
    for _ in range(steps):
        if state.filter("NOT done").isEmpty():
            break
        rate = tilt(F.col("size"), F.col("lam"), F.col("mean"), most)
        moved = F.col("n") * F.col("size") * rate
        sums = (cells.join(state.filter("NOT done").alias("s"), key)
                .groupBy("s.source").agg(F.sum(moved).alias("got"),
                                         F.sum(F.when(rate < most, moved * F.col("size") / F.col("mean"))
                                               .otherwise(0.0)).alias("slope")))
        s = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left")
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        # Steps stay within a factor of the bracket; outside it the bracket is halved.
        inside = (newton > lo) & (newton < hi) & (F.abs(newton - F.col("lam")) < 50)
        halved = F.when(lo <= -1e4, hi * 2 - 1).when(hi >= 1e4, lo * 2 + 1).otherwise((lo + hi) / 2)
        near = F.abs(gap) <= F.col("target") * 1e-7
        lam = F.when(F.col("s.done") | near, F.col("lam")).otherwise(F.when(inside, newton).otherwise(halved))
        state = stored(s.select(
            "s.source", "source_size", "rows", "target", "mean", lam.alias("lam"),
            F.when(F.col("s.done"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("s.done"), F.col("hi")).otherwise(hi).alias("hi"),
            (F.col("s.done") | near).alias("done")), "mixing-state")
    return state


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, source, size) of every row, stored, and the rows themselves with the same keys, as ``row``.

    The key is the id and a hash of the text.  Only where several rows share one (repeated rows) it also holds the row's place
    in a stored copy of the table, so that each of them is rounded and mended on its own.
    """
    base = F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("doc_id").isNull(), "-"), F.xxhash64("text"))

    def narrow(rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(key.alias("key"), "doc_id", "source", words_of().alias("size"))

    def wide(rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(key.alias("key"), "doc_id", "source", words_of().alias("size"),
                           F.struct(*docs.columns).alias("row"))

    rows = stored(narrow(docs, base), "mixing-sizes")
    repeated_ = rows.groupBy("key").count().filter("count > 1").select(F.col("key").alias("again"))
    if repeated_.isEmpty():
        return rows, wide(docs, base)
    repeated_ = stored(repeated_, "mixing-repeated")
    at = "_place"
    while at in docs.columns:
        at += "_"
    copy = stored(docs.withColumn(at, F.monotonically_increasing_id()), "mixing-rows")

    def numbered(rows: DataFrame) -> DataFrame:
        return (rows.join(repeated_, F.col("key") == F.col("again"), "left")
                .withColumn("key", F.concat_ws("/", "key", F.when(F.col("again").isNotNull(), F.col("at")))).drop("again", "at"))

    def placed(rows: DataFrame) -> DataFrame:
        return numbered(rows.withColumn("at", F.element_at(F.split("key", "/"), 2))
                        .withColumn("key", F.element_at(F.split("key", "/"), 1)))

    with_place = F.concat_ws("/", base, F.col(at))
    return stored(placed(narrow(copy, with_place)), "mixing-sizes"), placed(wide(copy, with_place))


def applied(rows: DataFrame, tilts: DataFrame, most: int, seed: int) -> DataFrame:
    """Rows (with key, source, size) with source_size, target, rate, u and the rounded copies."""
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), tilt(F.col("size"), F.col("lam"), F.col("mean"), most)) \
        .otherwise(0.0)
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    joined = rows.join(tilts.withColumnRenamed("source", "tilt_source"),
                       F.col("source").eqNullSafe(F.col("tilt_source"))).drop("tilt_source")
    return (joined.withColumns({"rate": rate, "u": chance})
            .withColumn("copies", (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
            .drop("mean", "lam"))


def planned(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, mass: float = MASS, most: int = int(MOST),
            seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(tilt of each source, single copies to add or take away) for stored key, source, size rows."""
    wanted = stored(targets(sizes, weights, mass, most), "mixing-targets")
    state = balanced(sizes, wanted, float(most))
    tilts = stored(wanted.alias("w").join(state.select("source", "mean", "lam").alias("s"),
                                          F.col("w.source").eqNullSafe(F.col("s.source")), "left")
                   .select("w.source", "source_size", "target", "mean", "lam"), "mixing-tilts")
    return tilts, stored(repairs(applied(sizes, tilts, most, seed), most), "mixing-repairs")


def counted(rows: DataFrame, tilts: DataFrame, fixes: DataFrame, most: int = int(MOST), seed: int = 11) -> DataFrame:
    """Rows with their final ``copies`` and ``taken``."""
    copies = F.col("copies") + F.coalesce("change", F.lit(0))
    return (applied(rows, tilts, most, seed).join(fixes, "key", "left")
            .withColumn("copies", copies.cast("int")).withColumn("taken", F.col("copies") * F.col("size")).drop("change", "u"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every row."""
    rows, _ = keyed(docs)
    return counted(rows, *planned(rows, **settings)).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay."""
    rows, bare = keyed(docs)
    taken = counted(bare, *planned(rows)).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def repairs(rounded: DataFrame, most: int, each: int = REPAIRS) -> DataFrame:
    """key, change (+1 or -1): single copies that bring each source's rounded sum to its target.

    At most ``each`` documents of a size class and source are candidates, so a source gathers a bounded list.
    """
    gap = stored(rounded.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
                 .select("source", F.round(F.col("target") - F.col("taken")).cast("long").alias("gap")).filter("gap != 0"),
                 "mixing-gaps")
    able = F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    pick = Window.partitionBy("source", "class").orderBy("u", "key")
    chosen = (rounded.filter("size > 0").alias("r")
              .join(gap.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
              .filter(able & (F.col("size") <= F.abs("gap")))
              .select("r.source", "gap", "key", "size", "u", F.floor(F.log2("size")).alias("class"))
              .withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= each))
    listed = chosen.groupBy("source", "gap").agg(
        F.sort_array(F.collect_list(F.struct("size", "key")), asc=False).alias("found"))
    start = F.struct(F.abs("gap").alias("left"), F.array().cast("array<string>").alias("ids"))
    walked = F.aggregate("found", start, lambda a, x: F.when(
        x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"),
                                         F.concat(a["ids"], F.array(x["key"])).alias("ids"))).otherwise(a))
    return (listed.select(F.signum("gap").cast("int").alias("change"), F.explode(walked["ids"]).alias("key")))
