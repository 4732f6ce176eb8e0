"""Joins with heavy and NULL keys."""

import statistics

import pytest
from pyspark.sql import functions as F

from platelake.operators.joins import heavy_keys, left_join


@pytest.fixture(scope="module")
def facts(spark):
    """60 % NULL keys, half of the others one key, the rest spread over 4,000 keys."""
    n = F.col("id")
    key = F.when(n % 10 < 6, None).when(n % 2 == 0, F.lit(7)).otherwise(100 + F.pmod(F.xxhash64("id"), F.lit(4000)))
    return spark.range(40_000).select(n.alias("row"), key.cast("bigint").alias("k")).repartition(8)


def test_heavy_keys(spark, facts):
    assert heavy_keys(facts, "k", 0.05) == [7]
    assert heavy_keys(facts.filter("k > 7"), "k", 0.05) == [] and heavy_keys(facts.limit(0), "k") == []
    assert heavy_keys(facts.filter("k IS NULL"), "k") == []


def test_no_task_holds_a_heavy_key_alone(spark, facts):
    dim = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(1).alias("_salt"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {c: spark.conf.get(c) for c in off}
    for c, v in off.items():
        spark.conf.set(c, v)
    try:
        def sizes(df):
            return [r["count"] for r in df.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]

        plain = sizes(facts.join(dim, "k", "left"))
        assert max(plain) > 2 * statistics.median(plain)
        salted = left_join(facts, dim, "k", heavy_keys(facts, "k", 0.05))
        found = sizes(salted)
        assert max(found) < 2 * statistics.median(found) and len(found) == 8
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert salted.columns == facts.join(dim, "k", "left").columns
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, facts.join(dim, "k", "left").collect()), key=str)


def test_repeated_keys_on_the_right_and_empty_sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k int, y int")
    got = sorted(map(tuple, left_join(left, right, "k", [1], 3).collect()), key=str)
    assert got == sorted([(1, "a", 10), (1, "a", 11), (1, "b", 10), (1, "b", 11), (None, "c", None), (2, "d", None)], key=str)
    assert left_join(left.limit(0), right, "k").count() == 0 and left_join(left, right.limit(0), "k", [1]).count() == 4
