"""What the physical plans must and must not contain."""

import pytest

from lakeworks.queries import ORACLES, QUERIES

FLAGSHIP = [
    "daily_revenue", "fct_orders", "dim_customers", "funnel_2step", "retention_curve", "multi_day_trend", "metric_sum",
    "white_space", "rls_range", "cdc_apply_batch", "return_rate", "rfm_features", "join_inner_using",
]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", FLAGSHIP)
def test_no_nested_loops_and_no_single_task_sorts(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    physical = text[text.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    lines = physical.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            assert not any("SinglePartition" in x for x in lines[i : i + 4]), line
    assert "BatchEvalPython" not in physical


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["incremental_extract"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in text
    schema = text[text.rindex("ReadSchema") :].splitlines()[0]
    assert "o_orderkey" not in schema and "o_totalprice" in schema
    ranged = plan(QUERIES["semi_range_exists"](spark, sf))
    assert "GreaterThanOrEqual(c_name" in ranged  # the ranges became a scan filter


def test_a_frequent_key_is_cut_before_the_shuffle(spark, sf):
    text = plan(QUERIES["dedup_latest"](spark, sf))
    assert "WindowGroupLimit" in text[text.index("== Physical Plan ==") :]


def test_top_k_does_not_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["clv_top100"](spark, sf))


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 240
    assert not [n for n in QUERIES if "pipeline" in n]
