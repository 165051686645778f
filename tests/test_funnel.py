"""Funnel levels against a brute-force reading of the rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditions, funnel

AS_OF = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


def brute(events, n, window_ms, strict):
    """events: (ts, step) of one user, in order of time then step."""
    starts = [None] * (n + 1)
    level = 0
    for ts, step in sorted(events):
        if step == 1:
            starts[1] = ts
            level = max(level, 1)
        elif strict and starts[step] is not None:
            break
        elif starts[step - 1] is not None and ts <= starts[step - 1] + window_ms:
            starts[step] = starts[step - 1] if starts[step] is None else max(starts[step], starts[step - 1])
            level = max(level, step)
    return level


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels(spark, strict, seed):
    rnd = random.Random(seed)
    rows = []
    for user in range(120):
        size = 400 if user == 0 else rnd.randrange(1, 14)
        rows += [(f"u{user}", rnd.randrange(60) * 1000, rnd.choice("abcdx")) for _ in range(size)]
    df = spark.createDataFrame(rows, "user_key string, ms long, event_name string").withColumn("event_time", F.timestamp_millis("ms"))
    steps = [F.col("event_name") == c for c in "abcd"]
    got = {r.user_key: r.level for r in funnel.funnel_level(df, steps, 10, strict).collect()}
    for user in {r[0] for r in rows}:
        hits = [(ms, "abcd".index(e) + 1) for u, ms, e in rows if u == user and e != "x"]
        assert got[user] == brute(hits, 4, 10_000, strict), user


def test_row_that_meets_two_steps(spark):
    df = spark.createDataFrame([("u", 0, "a")], "user_key string, ms long, event_name string").withColumn("event_time", F.timestamp_millis("ms"))
    steps = [F.col("event_name") == "a", F.col("event_name").startswith("a")]
    assert funnel.funnel_level(df, steps).first().level == 2


def test_discover_of_nobody_is_zero(spark):
    df = spark.createDataFrame([], "user_key string, event_name string, event_time timestamp, platform string")
    row = funnel.discover_group(df, [{"conditions": [{"fieldId": 21, "operator": 5, "value": "x"}]}], AS_OF).first()
    assert tuple(row) == (0, 0, 0.0)


def test_blank_and_unknown_rows_are_skipped(spark):
    rows = [
        {"fieldId": 21, "operator": 5, "value": "  "}, {"fieldId": 21, "operator": 77, "value": "x"},
        {"operator": 5, "value": "x"}, {"fieldId": 21, "operator": 5, "value": [None, ""]},
    ]
    pred = conditions.build_predicate([{"conditions": rows}], AS_OF)
    assert pred.where is None and pred.having == []


def test_page_view_guard_and_words(spark):
    frame = spark.createDataFrame(
        [("page_view", '{"path":"/a","query":"?x"}', 1, "u"), ("other", '{"path":"/a","query":"?x"}', 0, "")],
        "event_name string, event_params string, is_first_open long, user_id string",
    ).withColumn("user_properties", F.lit("{}"))
    rows = [{"fieldId": 32, "operator": 5, "value": "/a?x"}]
    assert frame.filter(conditions.build_predicate([{"conditions": rows}], AS_OF).where).count() == 1
    rows = [{"fieldId": 11, "operator": 5, "value": "returning"}]
    assert frame.filter(conditions.build_predicate([{"conditions": rows}], AS_OF).where).first().event_name == "other"
    rows = [{"fieldId": 12, "operator": 5, "value": "true"}]
    assert frame.filter(conditions.build_predicate([{"conditions": rows}], AS_OF).where).first().event_name == "page_view"


def test_period_keeps_the_last_day(spark):
    ms = [1704412799999, 1704412800000, 1704499199999, 1704499200000]
    df = spark.createDataFrame([(m,) for m in ms], "ms long").withColumn("event_time", F.timestamp_millis("ms"))
    day = dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc)
    assert [r.ms for r in funnel.in_period(df, day, day).orderBy("ms").collect()] == ms[1:3]
