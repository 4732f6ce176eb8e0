"""Document fingerprints by SpotSigs; DataFrame operations only.

A spot signature is a common word (anchor) with the chain of the next content words, common words skipped.  The
fingerprint of a text is the sorted set of its hashed signatures.  Likeness is the Jaccard similarity of two sets, pruned
by their lengths: sets whose sizes differ by more than the threshold allows are never intersected.

``near_pairs`` finds all likely copies: sets are partitioned by length so that only neighbouring partitions can hold a
pair, and inside them met through the rarest signatures of each set (a set must share one of those with any partner).
Equal sets are one representative there.

Defined cases: NULL is the empty text.  A text without words has the empty fingerprint, which is like itself only (1) and
unlike any other (0).  A text without a full chain after an anchor takes every word as an anchor, and if it is shorter
than a chain, its whole word sequence as the one signature.  Rows with one doc_id are ordered by their text.  After the
last document comes the first; a single document is its own successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from platelake.sources.workspace import stored

CHAIN = 2
# Common words of English, German, French and Spanish; a parameter of every function below.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "al con de del el en es la las lo los no para por que se su un una y")


def signatures(text: Column, anchors: str = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted set of the 40-bit hashes of a text's spot signatures."""
    common = F.array(*[F.lit(w) for w in sorted(set(anchors.split()))])
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def hashed(chain_of: Column, anchor: Column) -> Column:
        return F.xxhash64(anchor, chain_of).bitwiseAND(F.lit((1 << 40) - 1))

    # "of the house was red" -> "of|the|house", "was|red": every content word with the anchors right before it.
    runs = F.transform(words, lambda w: F.when(F.array_contains(common, w), F.concat(w, F.lit("|")))
                       .otherwise(F.concat(w, F.lit(" "))))

    def spots(pieces: Column, content: Column) -> Column:
        last = F.size(content) - chain
        found = F.filter(F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                         lambda s: s["p"].contains("|") & (s["i"] <= last))
        return F.flatten(F.transform(found, lambda s: F.transform(
            F.slice(F.split(s["p"], r"\|"), F.lit(1), F.size(F.split(s["p"], r"\|")) - 1),
            lambda a: hashed(F.array_join(F.slice(content, s["i"] + 1, chain), " "), a))))

    def every(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
            F.size(w) <= chain, F.array(hashed(F.array_join(w, " "), F.lit("")))).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - chain),
                        lambda i: hashed(F.array_join(F.slice(w, i + 1, chain), " "), F.element_at(w, i))))

    # Intermediate values are bound by one-element transforms, so that none is worked out twice.
    def of_pieces(pieces: Column) -> Column:
        return F.element_at(F.transform(
            F.array(F.transform(pieces, lambda p: F.substring_index(p, "|", -1))), lambda c: spots(pieces, c)), 1)

    def of_words(w: Column, joined: Column) -> Column:
        found = F.element_at(F.transform(
            F.array(F.filter(F.split(joined, " "), lambda p: (p != "") & ~p.endswith("|"))), of_pieces), 1)
        return F.element_at(F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, s).otherwise(every(w))), 1)

    return F.array_sort(F.array_distinct(of_words(words, F.array_join(runs, ""))))


def fingerprint(found: Column) -> Column:
    """The set as text: ten hexadecimal digits for each signature."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without intersecting them if their lengths rule out ``least``."""
    n, m = F.size(a), F.size(b)
    small, large = F.least(n, m), F.greatest(n, m)
    both = F.size(F.array_intersect(a, b))
    return (F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(least)), F.lit(0.0))
            .otherwise(both / (n + m - both)))


def successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows of doc_id, text, found (signatures) with next_text and next_found of the document after it by doc_id.

    Ids are cut into ranges at percentiles; the first row of each range is also sent to the range before it, so each
    window sees its successor and the texts are shuffled once.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / ranges for i in range(ranges - 1)] or [0.5],
                                        20 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    range_of = _range_of(F.col("doc_id"), cuts)
    firsts = [tuple(r) for r in docs.groupBy(range_of.alias("r")).agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull()))
              .orderBy("r").collect()]  # one row for each range
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("range", range_of)
    used = [r for r, *_ in firsts]
    # Of each range's rows that open it, all copies go to the range before, as ghosts; the window takes the nearest.
    opens = [None if nulls else first for _, first, nulls in firsts]
    before = {opened: used[k - 1] for k, opened in enumerate(opens)}
    ghost = F.lit(None).cast("int")
    ring = F.lit(False)
    for k, opened in enumerate(opens):
        here = F.col("doc_id").isNull() if opened is None else F.col("doc_id") == F.lit(opened)
        if k == 0:
            ring = here
    table = [(opened, int(before[opened])) for opened in opens if opened is not None]
    if table:
        ids, to = F.lit([o for o, _ in table]), F.lit([t for _, t in table])
        at = F.array_position(ids, F.col("doc_id")).cast("int")
        ghost = F.when(at > 0, F.element_at(to, at))
    if opens and opens[0] is None:
        ghost = F.when(F.col("doc_id").isNull(), F.lit(int(before[None]))).otherwise(ghost)
    sent = rows.withColumn("to", F.explode(F.when(ghost.isNull(), F.array(
        F.struct(F.col("range").alias("range"), F.lit(0).alias("turn")))).otherwise(F.array(
            F.struct(F.col("range").alias("range"), F.lit(0).alias("turn")),
            F.struct(ghost.alias("range"), F.when(ring, 2).otherwise(1).alias("turn"))))))
    dealt = sent.select("doc_id", "text", F.col("to.range").alias("range"), F.col("to.turn").alias("turn"))
    dealt = dealt.repartition("range").withColumn("found", signatures(F.col("text")))
    order = Window.partitionBy("range").orderBy("turn", F.col("doc_id").asc_nulls_first(), "text")
    return (dealt.withColumns({"next_text": F.lead("text").over(order), "next_found": F.lead("found").over(order)})
            .filter("turn = 0"))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value, by binary search; 0 for NULL."""
    if not cuts:
        return F.lit(0)
    array, n = F.lit(cuts), len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        at + s > n, at).when(F.element_at(array, F.least(at + s, F.lit(n))) < value, at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text").cast("long")
    cut = F.floor(F.length("text") / 4).cast("int")
    rows = successors(docs).withColumns({
        "n_chars": n, "edited": F.concat(F.substring("text", F.lit(1), F.length("text") - cut),
                                         F.substring("next_text", F.lit(1), cut))})
    rows = rows.withColumn("edited_found", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited", fingerprint(F.col("found")).alias("fingerprint"),
                       fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
                       likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
                       likeness(F.col("found"), F.col("next_found")).alias("near_next"))


def near_pairs(docs: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b with likeness >= least between representatives, membership doc_id -> representative).

    Partition p of the lengths holds sizes from ``(1 / least) ** p``; a pair's sizes lie in one partition or in two
    neighbouring ones.  Documents without signatures are in no pair.
    """
    from math import log

    sets = stored(docs.filter("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("found"))
                  .filter(F.size("found") > 0), "spotsigs-sets")
    member = sets.withColumn("print", F.sha2(fingerprint(F.col("found")), 256))
    reps = member.groupBy("print").agg(F.min("doc_id").alias("rep"))
    membership = member.select("doc_id", "print").join(reps, "print").select("doc_id", "rep")
    found = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    found = stored(found.withColumn("n", F.size("found")), "spotsigs-reps")
    items = found.select("doc_id", "n", F.explode("found").alias("sig"))
    rare = items.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = items.join(rare, "sig", "left").groupBy("doc_id", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("by"))
    prefix = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1)
    part = F.floor(F.log("n") / log(1 / least) + 1e-12).cast("int")
    probes = stored(ranked.select("doc_id", "n", part.alias("part"), F.explode(prefix).alias("s"))
                    .filter("s.df > 1").select("doc_id", "n", "part", "s.sig"), "spotsigs-probes")
    other = probes.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), "sig",
                          F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = (probes.withColumnRenamed("doc_id", "a").join(other, ["sig", "part"])
             .filter((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(least)))
             .select("a", "b").distinct())
    checked = (pairs.join(found.select(F.col("doc_id").alias("a"), F.col("found").alias("fa")), "a")
               .join(found.select(F.col("doc_id").alias("b"), F.col("found").alias("fb")), "b")
               .select("a", "b", likeness(F.col("fa"), F.col("fb"), least).alias("likeness"))
               .filter(F.col("likeness") >= least))
    return checked, membership
