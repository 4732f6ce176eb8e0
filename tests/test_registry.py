"""Registered queries: contract, agreement with SQL on the smallest data, and plan shape."""

import pytest

import __spark_entry__ as e
from platelake.plans.registry import QUERIES
from tests.compare import compare, duck

SAMPLE = [
    "unit_performance_daily", "sos_compliance_summary", "silver_guest_profile", "f_sos_compliance", "f_franchisee_scorecard",
    "f_tender_mix", "metric_franchisee", "q_digital_adoption", "q_top_decile_customers", "demand_risk_forecast",
    "order_reconciliation", "reshape_orders", "customer_features", "rank_recommendations", "recommendation_lists",
    "build_feature_vector", "expected_demand", "price_drift", "weather_json_scan", "classify_pii_documents",
    "stream_static_join", "stream_gold_daily", "integrity_keys", "scd1_stream", "incremental_refresh", "merge_weather", "append_evolving"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) - set(e.oracle_sql()) == {"train_ranker", "profile_table", "score_batch_learned", "profile_staging"}


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["unit_id", "date", "order_count", "daily_revenue", "avg_order_value", "cancelled_count"]
    assert df.count() > 0


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, con, sf_dir, key):
    got = e.queries()[key](spark, sf_dir).toArrow()
    assert compare(got, con.sql(e.oracle_sql()[key]).to_arrow_table()) is None


@pytest.mark.parametrize("key", ["unit_performance_daily", "f_sos_compliance", "metric_menu", "rank_recommendations", "reshape_orders",
                                 "price_line", "demand_risk_forecast"])
def test_plans_stay_in_the_engine(spark, sf_dir, key):
    plan = e.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, bad


def test_one_branch_is_scanned_for_one_event_type(spark, sf_dir):
    plan = e.queries()["silver_payment"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "lineitem" not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = e.queries()["f_revenue_by_channel"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in plan and "c_mktsegment" not in plan and "o_orderstatus" not in plan.split("Subquery")[0]
