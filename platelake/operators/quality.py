"""Row expectations and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def expect_or_drop(df: DataFrame, rules: dict[str, str],
                   observation: Observation | None = None) -> DataFrame:
    """Keep rows that satisfy every rule.

    A rule that evaluates to NULL counts as failed.  With an ``observation`` the
    failures per rule are counted while the rows stream past, at no extra scan.
    """
    if observation is not None:
        counts = [F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()]
        df = df.observe(observation, *counts)
    for rule in rules.values():
        df = df.filter(F.expr(rule))
    return df


def failed_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule: rows seen and rows failed."""
    aggs = [F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()]
    flat = df.agg(F.count(F.lit(1)).alias("rows_seen"), *aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows_failed")) for n in rules])
    return (flat.select("rows_seen", F.explode(pairs).alias("p"))
            .select("p.rule", "rows_seen", "p.rows_failed"))


def check(name: str, df: DataFrame, bad) -> DataFrame:
    return df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def duplicate_keys(name: str, df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    dup = df.groupBy(key).count().filter("count > 1")
    return dup.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def orphans(name: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent.

    The child is first reduced to one row per key, so a hot key crosses the
    join once however many rows carry it.
    """
    per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = per_key.join(parent.select(key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(name).alias("check_name"), "violations")


def combined(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def key_checks(tables: dict[str, DataFrame], primary: dict[str, str], foreign: dict[str, tuple[str, ...]]) -> DataFrame:
    """Repeated primary keys of every table, and orphans of every foreign key; 0 is healthy.

    ``foreign`` lists the parents of a table, which are found by their primary key's name.
    """
    unique = [duplicate_keys(f"{name}_key_unique", tables[name], key) for name, key in primary.items()]
    known = [orphans(f"{child}_has_{parent}", tables[child], tables[parent], primary[parent])
             for child, parents in foreign.items() for parent in parents]
    return combined(unique + known)


def validate_integrity(guest_order: DataFrame, order_item: DataFrame, payment: DataFrame,
                       menu_item: DataFrame) -> DataFrame:
    """Money identities, vocabulary, key uniqueness and references; 0 is healthy."""
    cents = lambda c: F.floor(F.col(c) * 100 + F.lit(0.5))
    fine = lambda c: F.floor(F.col(c) * 10000 + F.lit(0.5))
    checks = [
        check("total_is_subtotal_plus_tax", guest_order,
              cents("total_amount") != cents("subtotal") + cents("tax_amount")),
        check("net_is_gross_minus_discount", order_item,
              fine("line_net_amount") != fine("line_gross_amount") - fine("line_discount_amount")),
        check("known_order_status", guest_order, ~F.col("order_status").isin("fulfilled", "cancelled")),
        duplicate_keys("guest_order_key_unique", guest_order, "guest_order_id"),
        duplicate_keys("order_item_key_unique", order_item, "order_item_id"),
        orphans("order_item_has_order", order_item, guest_order, "guest_order_id"),
        orphans("order_item_has_menu_item", order_item, menu_item, "menu_item_id"),
        orphans("payment_has_order", payment, guest_order, "guest_order_id"),
    ]
    return combined(checks)
