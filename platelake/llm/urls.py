"""URL filter: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is built as rows (block, eight 64-bit words): each listed URL sets one bit in every word of the block that its
hash names.  The number of blocks grows with the list, so the share of false hits stays the same for any list; pages meet their
block in a join, which Spark broadcasts while the filter is below the session's threshold and deals out by block beyond it.
Pages whose bits are all set are possible hits, and only those are joined to
the list, which removes the false ones.  All other pages skip that join.

Rules are a short, fixed configuration: host and path prefix with a verdict.  A rule fits its host and all subdomains if
the path starts with its path; the longest one wins.

Defined cases: a NULL URL or one without ``://`` has empty host and path, fits no rule and is allowed.  Repeated pages are
each judged; repeated and NULL entries of the list count once or not at all; an empty list blocks nothing, an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
WORDS = 8
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www, path without closing slashes, query without tracking fields; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), r"&(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    whole = F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host != "", whole)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest fitting rule, NULL if none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """One bit of a 64-bit word, from the second hash of the key."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit(101)), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter's rows (block, w0 .. w7) and its number of blocks."""
    need = keys.agg(F.approx_count_distinct(key)).first()[0] * BITS_PER_URL / (64 * WORDS)
    blocks = max(1, int(need) + 1)
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *[_bit(F.col(key), i).alias(f"w{i}") for i in range(WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed for every page; ``listed`` has a column url."""
    keys = listed.select(canonical(F.col("url")).alias("key")).filter("key IS NOT NULL").distinct()
    filter_rows, blocks = bloom(keys, "key")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        canonical(F.col("url")).alias("key"))
    rows = rows.withColumn("block", _block(F.col("key"), blocks)).join(filter_rows, "block", "left")
    all_set = F.lit(True)
    for i in range(WORDS):
        all_set = all_set & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(_bit(F.col("key"), i)) != 0)
    rows = rows.withColumn("possible", F.coalesce(all_set, F.lit(False))).select("page_id", "host", "path", "key", "possible")
    hits = rows.filter("possible").join(keys.withColumn("hit", F.lit(True)), "key", "left")
    both = hits.select("page_id", "host", "path", "key", F.coalesce("hit", F.lit(False)).alias("listed")).union(
        rows.filter("NOT possible").select("page_id", "host", "path", "key", F.lit(False)))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    return both.select("page_id", "host", "path", name.alias("rule"),
                       F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
                       F.col("key").alias("canonical"), "listed")
