"""Metric views fold the facts before they join dimensions."""

import pytest
from pyspark.sql import functions as F

from platelake.operators.metric_view import (Field, Join, MetricView, count_of, count_rows, distinct, mean, mean_money, money, share,
                                             total)


@pytest.fixture(scope="module")
def view(spark):
    sales = spark.createDataFrame(
        [(i % 7 if i % 11 else None, i % 3, float(i), i % 13 if i % 5 else None, i % 4 == 0 if i % 9 else None) for i in range(500)],
        "unit_id int, item int, amount double, guest int, late boolean")
    unit = spark.createDataFrame([(i, f"store {i % 4}", i % 2) for i in range(6)], "unit_id int, store string, owner_id int")
    owner = spark.createDataFrame([(0, "A"), (1, "B")], "owner_id int, owner string")
    return MetricView(
        sales,
        {"Item": F.col("item"), "Store": Field(F.col("u_store"), ["unit"]), "Owner": Field(F.col("o_owner"), ["owner"])},
        {"Rows": count_rows(), "Amount": money("amount"), "Mean": mean_money("amount"), "Guests": distinct("guest"),
         "Late": share(F.col("late")), "LateRows": count_of(F.col("late")), "Guest": mean("guest"), "Sum": total("item"),
         "PerLate": money("amount") / count_of(F.col("late")),
         "Stores": Field(distinct(F.when(F.col("u_store").isNotNull(), F.col("unit_id"))), ["unit"])},
        {"unit": Join(unit, "unit_id", {"u_store": "store", "owner_id": "owner_id"}),
         "owner": Join(owner, "owner_id", {"o_owner": "owner"}, needs=["unit"])})


ALL = ["Rows", "Amount", "Mean", "Guests", "Late", "LateRows", "Guest", "Sum", "PerLate", "Stores"]


def plain(view, dims, where=None):
    """Every join first, then one aggregation of the rows."""
    df = view.source
    for name in ("unit", "owner"):
        df = view._joined(df, [view.joins[name]])
    expr = lambda f: f.expr if isinstance(f, Field) else f
    for name, test in (where or {}).items():
        df = df.filter(test(expr(view.dimensions[name])))
    return df.groupBy(*[expr(view.dimensions[d]).alias(d) for d in dims]).agg(*[expr(view.measures[m]).of_rows().alias(m) for m in ALL])


@pytest.mark.parametrize("dims,where", [
    (["Store"], None), (["Owner", "Item"], None), ([], None), (["Item"], {"Owner": lambda c: c == "A"}),
    (["Owner"], {"Item": lambda c: c > 0}), (["Store", "Owner"], {"Store": lambda c: c.isNull()})])
def test_folded_results_are_those_of_the_rows(view, dims, where):
    got = view.query(dims, ALL, where).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain(view, dims, where).collect()), key=str)


def test_the_join_meets_folded_rows(view):
    plan = view.query(["Store"], ["Amount", "Mean"])._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().split("\n")
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip(" :+-"))
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert any("Aggregate [" in x and depth(i) > depth(join) for i, x in enumerate(lines) if i > join)
    assert sum("Aggregate [" in x for x in lines) == 2


def test_a_fine_key_is_not_folded(view, spark):
    fine = MetricView(view.source, {"Store": Field(F.col("u_store"), ["unit"])}, {"Rows": count_rows()},
                      {"unit": Join(view.joins["unit"].table, "unit_id", {"u_store": "store"}, fine=True)})
    plan = fine.query(["Store"], ["Rows"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    assert sorted(map(tuple, fine.query(["Store"], ["Rows"]).collect()), key=str) == sorted(
        map(tuple, view.query(["Store"], ["Rows"]).collect()), key=str)


def test_unknown_names_raise(view):
    with pytest.raises(KeyError):
        view.query(["Nope"], ["Rows"])
    with pytest.raises(KeyError):
        view.query([], ["Nope"])
