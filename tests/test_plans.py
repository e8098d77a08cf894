"""Physical-plan properties the design relies on."""

from leadlens.plans.catalog import QUERIES

from .conftest import SF_SMALL


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_is_take_ordered_with_pruned_scan(spark):
    df = QUERIES["latest_predictions"](spark, SF_SMALL)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan
    read = [ln for ln in plan.splitlines() if "events.parquet" in ln][0]
    assert "value" not in read.split("ReadSchema:")[-1]          # unused column not read


def test_rates_without_history_read_the_tables_directly(spark):
    plan = _plan(QUERIES["rate_by_month"](spark, SF_SMALL))
    assert "ordered-scan" not in plan and "Python" not in plan
    read = [ln for ln in plan.splitlines() if "orders.parquet" in ln][0]
    assert "o_totalprice" not in read.split("ReadSchema:")[-1]


def test_split_is_a_comparison_with_cut_keys(spark):
    plan = _plan(QUERIES["stratified_split"](spark, SF_SMALL))
    assert "ordered-scan" not in plan and "Python" not in plan


def test_dimension_tables_broadcast(spark):
    plan = _plan(QUERIES["contacts"](spark, SF_SMALL))
    assert plan.count("BroadcastHashJoin") >= 2
