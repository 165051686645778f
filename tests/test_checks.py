"""Every registered query beside its check SQL."""

import pytest

from tidemark.plans import CHECKS, QUERIES
from tidemark.plans.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_check(spark, con, name):
    found = [d for d in differences(spark, con, name, SF_DIR) if d != "check has no rows"]
    assert not found


def test_all_but_estimates_have_a_check():
    assert set(QUERIES) - set(CHECKS) == {"merge_rollup_sketch"}


def test_sketch_estimate_is_close(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import rollup
    from tidemark.plans.registry import Tables

    t = Tables(spark, SF_DIR)
    near = QUERIES["merge_rollup_sketch"](spark, SF_DIR).withColumnRenamed("device_count", "near")
    exact = t.pages.groupBy("page_name").agg(F.count_distinct("device_id").alias("exact"))
    for row in near.join(exact, "page_name").collect():
        assert abs(row.near - row.exact) <= max(1, 0.05 * row.exact)
    assert rollup.page_daily(t.pages, sketch=True).columns[-1] == "device_sketch"
