"""Profiles merged from stored states against the rows themselves."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from platelake.operators import profile


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    start = datetime(2026, 3, 1)
    data = [(i, rng.gauss(50, 12) if i % 9 else None, f"v{rng.randrange(900)}", i % 3 == 0, [i % 5],
             start + timedelta(minutes=5 * i) if i % 50 else None) for i in range(6000)]
    return spark.createDataFrame(data, "id bigint, amount double, name string, flag boolean, tags array<int>, at timestamp"), data


def test_a_merged_week_is_the_profile_of_its_rows(spark, rows, tmp_path):
    df, data = rows
    store = profile.ProfileStore(spark, str(tmp_path))
    store.measure(df, "t", F.to_date("at"))
    store.measure(df.limit(10), "other", F.to_date("at"))
    got = {r.column_name: r for r in store.profile("t", "2026-03-03", "2026-03-09").collect()}
    days = [r for r in data if r[5] and 3 <= r[5].day <= 9 and r[5].month == 3]
    amounts = [r[1] for r in days if r[1] is not None]
    a = got["amount"]
    assert (a.rows, a.nulls, a.low, a.high) == (len(days), len(days) - len(amounts), min(amounts), max(amounts))
    assert a.mean == pytest.approx(statistics.mean(amounts)) and a.deviation == pytest.approx(statistics.pstdev(amounts))
    for q, cut in zip(a.quartiles, statistics.quantiles(amounts, n=4)):
        assert sum(x < q for x in amounts) / len(amounts) == pytest.approx(sum(x < cut for x in amounts) / len(amounts), abs=0.03)
    assert got["name"].distinct_values == pytest.approx(len({r[2] for r in days}), rel=0.05)
    assert got["tags"].distinct_values == 5 and got["flag"].high == 1.0 and got["name"].low is None and got["name"].quartiles is None
    # The same from one state of the week's rows.
    week = df.filter(F.to_date("at").between("2026-03-03", "2026-03-09"))
    whole = {r.column_name: r for r in profile.merged(profile.states(week, "t")).collect()}
    for name, r in got.items():
        w = whole[name]
        assert (r.rows, r.nulls, r.low, r.high) == (w.rows, w.nulls, w.low, w.high)
        assert r.distinct_values == pytest.approx(w.distinct_values, rel=0.03)
    everything = {r.column_name: r for r in store.profile("t").collect()}
    assert everything["at"].nulls == 120 and everything["id"].rows == 6000


def test_a_day_measured_again_replaces_its_states(spark, rows, tmp_path):
    df, _ = rows
    store = profile.ProfileStore(spark, str(tmp_path))
    assert store.profile("t") is None
    store.measure(df, "t", F.to_date("at"))
    store.measure(df.filter(F.to_date("at") == "2026-03-05"), "t", F.to_date("at"))
    got = {r.column_name: r.rows for r in store.profile("t").collect()}
    assert set(got.values()) == {6000}
    states = store.table.read()
    assert states.count() == 6 * states.select("day").distinct().count()


def test_odd_tables(spark, tmp_path):
    store = profile.ProfileStore(spark, str(tmp_path))
    df = spark.createDataFrame([(float("nan"), None), (None, None), (2.0, None)], "x double, `a.b` string")
    store.measure(df, "odd")
    got = {r.column_name: r for r in store.profile("odd").collect()}
    assert (got["x"].rows, got["x"].nulls, got["x"].low, got["x"].high) == (3, 1, 2.0, 2.0)
    assert (got["a.b"].nulls, got["a.b"].distinct_values) == (3, 0)
    assert profile.merged(profile.states(df.limit(0), "none")).count() == 0


def test_one_scan_for_all_columns(rows):
    df, _ = rows
    plan = profile.states(df, "t", F.to_date("at"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and plan.count("Aggregate [") == 1
