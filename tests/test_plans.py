"""Shapes of the physical plans: no pairwise joins, no Python in the hot path, limits before the shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import QUERIES
from tidemark.plans.registry import Tables

SF_DIR = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: physical(build(spark, SF_DIR)) for name, build in QUERIES.items()}


def test_no_query_compares_pairs_or_runs_python(plans):
    found = {name: [word for word in FORBIDDEN if word in plan] for name, plan in plans.items()}
    assert not {name: hits for name, hits in found.items() if hits}


def test_no_window_orders_a_whole_frame(plans):
    """A window without a partition puts a whole frame in one task."""
    assert not [name for name, plan in plans.items() if _global_window(plan)]


def _global_window(plan):
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and i + 2 < len(lines):
            below = " ".join(lines[i + 1 : i + 3])
            if "Exchange SinglePartition" in below:
                return True
    return False


@pytest.mark.parametrize("name", ["top_pages", "event_timeline", "models_by_os"])
def test_top_n_is_limited_before_the_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name]


@pytest.mark.parametrize("name", ["keyset_page", "trouble_list_crash", "pv_detail"])
def test_lists_take_the_first_rows_without_a_sort(plans, name):
    assert "TakeOrderedAndProject" in plans[name] and "rangepartitioning" not in plans[name]


def test_scans_read_only_their_columns(spark):
    plan = physical(Tables(spark, SF_DIR).events.groupBy("device_id").agg(F.max("log_tm")))
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "ts:" in schema and "user_id:" in schema and "props" not in schema and "value" not in schema


def test_time_range_also_prunes_days(spark):
    from tidemark.operators.common import between_ms

    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "log_tm long, log_date date")
    plan = between_ms(df, "log_tm", 1704067200000, 1704153600000)._jdf.queryExecution().optimizedPlan().toString()
    assert "log_date" in plan.split("Filter")[1] and "2024-01-01" in plan


def test_json_is_parsed_once_a_row_however_many_conditions_ask(plans):
    plan = plans["condition_operators_variant"]
    assert 1 <= plan.count("parseJson(") <= 2 and plan.count("variant_get(") > 5
