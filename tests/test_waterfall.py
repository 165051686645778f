"""Waterfall operators on rows of their own."""

import json

import pytest

from tidemark.operators import waterfall
from tidemark.sources import driver_tables

SCHEMA = "device_id string, page_id long, seq int, entry string"


def frame(spark, rows):
    return spark.createDataFrame([(d, p, seq, json.dumps(entry).replace(",", "^")) for d, p, seq, entry in rows], SCHEMA)


def paint(url, size):
    return {"url": url, "size": str(size), "2": "largest-contentful-paint", "3": "5"}


def named(name, kind="resource", start="1", **more):
    return {"1": name, "2": kind, "3": start, **more}


@pytest.fixture(scope="module")
def views(spark):
    return frame(spark, [
        # Two paints of one size: the first counts. Its name stands twice, and once as a navigation, which does not count.
        ("d", 1, 1, named("a", "navigation")), ("d", 1, 2, named("b")), ("d", 1, 3, named("a")), ("d", 1, 4, named("a")),
        ("d", 1, 5, paint("a", 10)), ("d", 1, 6, paint("b", 10)),
        # The largest paint names no entry; the smaller one does not step in.
        ("d", 2, 1, named("a")), ("d", 2, 2, paint("a", 1)), ("d", 2, 3, paint("c", 2)),
        # Neither without a URL nor of size 0.
        ("d", 3, 1, named("a")), ("d", 3, 2, paint("a", 0)), ("d", 3, 3, paint("", 9)),
        # A view needs both ids, and a view that comes twice is one.
        (None, 4, 1, named("a")), (None, 4, 2, paint("a", 3)), ("d", None, 1, named("a")), ("d", None, 2, paint("a", 3)),
        ("e", 5, 1, named("a")), ("e", 5, 2, paint("a", 3)), ("e", 5, 1, named("a")), ("e", 5, 2, paint("a", 3)),
    ])


def test_first_entry_of_the_largest_paint(spark, views):
    found = waterfall.mark_lcp(waterfall.read_entries(views))
    assert sorted(found.collect()) == [("d", 1, "a", 10, 3), ("e", 5, "a", 3, 1)]


def test_paints_meet_their_entries_without_a_join(spark, views):
    """The planner takes unfolded entries for few rows, so a join would be a broadcast of all of them."""
    plan = waterfall.mark_lcp(waterfall.read_entries(views))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and plan.count("Generate explode") == 1


def test_rows_of_first_navigations_and_others(spark):
    nav = {"18": "5", "19": "7", "22": "9", "26": "200"}  # request, response and its end: phases Waiting, Request Time, Response Time
    given = frame(spark, [
        # The first navigation shows no phase, so a later one shows none either.
        ("d", 1, 1, named("n", "navigation", "0")), ("d", 1, 2, named("n", "navigation", "1", **nav)), ("d", 1, 3, named("", "mark", "4")),
        # Two with the same place count both; other entries follow by start, whatever their order.
        ("d", 2, 1, named("n", "navigation", "1", **nav)), ("d", 2, 1, named("n", "navigation", "2", **nav)),
        ("d", 2, 3, named("y", start="8", **{"5": "IMG"})), ("d", 2, 2, named("x", start="9")), ("d", 2, 4, paint("y", 4)),
        (None, None, 1, named("z", "")),
    ])
    rows = waterfall.waterfall_rows(waterfall.read_entries(given)).collect()
    shown = sorted(((r.page_id or 0, r.position, r.name, r.kind, r.start_time, r.mark) for r in rows))
    phase = "reformnavigation"
    assert shown == [
        (0, 1, "z", "other", 1.0, None), (1, 1, "mark", "mark", 4.0, None),
        (2, 1, "Waiting", phase, 1.0, None), (2, 2, "Waiting", phase, 2.0, None), (2, 3, "Request Time", phase, 5.0, None),
        (2, 4, "Request Time", phase, 5.0, None), (2, 5, "Response Time", phase, 7.0, None), (2, 6, "Response Time", phase, 7.0, None),
        (2, 7, "y", "largest-contentful-paint", 5.0, None), (2, 8, "y", "img", 8.0, "lcp"), (2, 9, "x", "resource", 9.0, None),
    ]


def test_rows_are_sorted_once(spark, views):
    plan = waterfall.waterfall_rows(waterfall.read_entries(views))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


def test_partitions_of_entries_follow_from_the_rows(spark, tmp_path, monkeypatch):
    """Entries take many times the bytes of their views, so adaptive execution must not join partitions by the latter."""
    events = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_millis(1704067200000 + id) AS ts", "id AS user_id", "'view' AS event_type", "1.5D AS value", "'{\"k\": 7}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(driver_tables, "VIEWS_A_PART", 50)
    assert driver_tables.perf_entries(spark, str(tmp_path)).rdd.getNumPartitions() == 20
