"""Running values over cut-up groups equal plain windows, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.segmented import SegmentedScan, percentiles, value_slices
from tidemark.operators import session


def skewed(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(50)}"
        rows.append((key, rnd.randrange(20_000), i, rnd.choice([None, rnd.randrange(9)])))
    return spark.createDataFrame(rows, "k string, ts long, id long, v long")


def test_scan_equals_windows(spark):
    df = skewed(spark)
    got = (
        SegmentedScan(df, ["k"], ["ts", "id"], F.floor(F.col("ts") / 500))
        .lag("lag_v", "v").lead("lead_v", "v").running_sum("sum_v", F.col("v")).running_last("last_v", F.col("v"))
        .total("total_v", F.col("v")).lowest("low_ts", "ts").done()
    )
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.lag("v").over(w).alias("lag_v"), F.lead("v").over(w).alias("lead_v"),
        F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("sum_v"), F.last("v", True).over(upto).alias("last_v"),
        F.sum("v").over(Window.partitionBy("k")).alias("total_v"), F.min("ts").over(Window.partitionBy("k")).alias("low_ts"),
    )
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_percentiles_equal_numpy(spark):
    df = skewed(spark, seed=2).withColumn("g", F.when(F.col("k") == "k1", F.lit(None)).otherwise(F.col("k")))
    got = {r.g: r for r in percentiles(df, ["g"], "ts", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    rows = df.toPandas()
    rows["g"] = rows["g"].where(rows["g"].notna(), None)
    for g, part in rows.groupby("g", dropna=False):
        r = got[None if g is None or g != g else g]
        assert r.n == len(part)
        for name, p in (("p5", 5), ("p50", 50), ("p95", 95)):
            assert r[name] == pytest.approx(np.percentile(part["ts"], p))


@pytest.mark.parametrize("value", ["rand(1)", "1000 + rand(1) / 1000", "exp(20 * rand(1))", "pow(rand(1), 40)", "cast(rand(1) * 3e6 AS bigint)"])
def test_value_slices_hold_few_values_each(spark, value):
    """A million values of one group, whatever their scale and distribution, and a small group beside it."""
    df = spark.range(1_000_000).selectExpr("'hot' AS g", f"{value} AS v").unionByName(spark.range(100).selectExpr("'cold' AS g", "cast(id AS double) AS v"))
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    slices = value_slices(counts, ["g"], "v").groupBy("g", "_segment").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    hot = sorted((s for s in slices if s.g == "hot"), key=lambda s: s._segment)
    total = sum(s.n for s in hot)
    assert total == counts.filter("g = 'hot'").count() and max(s.n for s in hot) < 0.04 * total
    assert all(a.high < b.low for a, b in zip(hot, hot[1:]))
    assert [(s._segment, s.n) for s in slices if s.g == "cold"] == [(0, 100)]


def test_percentiles_of_many_values(spark):
    df = spark.range(60_000).selectExpr("id % 2 AS g", "if(id % 2 = 0, pow(rand(3), 9), rand(4) * 5) AS v")
    got = {r.g: r for r in percentiles(df, ["g"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
    for g, rows in df.toPandas().groupby("g"):
        want = np.quantile(rows.v, [0.01, 0.5, 0.99])
        assert got[g].n == len(rows) and np.allclose([got[g].p1, got[g].p50, got[g].p99], want, rtol=1e-12)


def test_percentiles_of_everything_and_of_nothing(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "x long")
    assert percentiles(df, [], "x", {"m": 0.5}).first().m == 2.0
    assert percentiles(df.filter("x > 9"), [], "x", {"m": 0.5}).collect() == []


def test_sessions_equal_a_plain_loop(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(2500):
        device = "hot" if rnd.random() < 0.5 else f"d{rnd.randrange(40)}"
        start = rnd.randrange(5_000_000)
        rows.append((device, start, i, rnd.choice([131073, 131073, 131073, 1048597]), f"u{i}", start + rnd.randrange(900)))
    df = spark.createDataFrame(rows, "device_id string, page_start_tm long, page_id long, log_type long, req_url string, page_end_tm long")
    got = {r.page_id: r for r in session.sessionize(df, gap_ms=4000, width=10_000).collect()}
    assert len(got) == len(rows)
    last = {}
    for device, start, i, kind, url, end in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        prev = last.get(device)
        if prev is None or start - prev[0] > 4000 or kind == 1048597:
            head, order = start, 1
        else:
            head, order = prev[3], prev[4] + 1
        r = got[i]
        assert (r.parent_log_date, r.flow_order) == (head, order)
        assert (r.pre_url, r.pre_url_time) == (("", 0) if prev is None else (prev[1], prev[2]))
        last[device] = (start, url, end, head, order)


def test_statistic_history_over_long_gaps(spark):
    import datetime as dt

    from tidemark.operators import kpi

    rnd = random.Random(5)
    first = dt.date(2024, 1, 1)
    rows = [(first + dt.timedelta(days=rnd.choice([d, d, 200])), "p", 0, "Web", f"d{rnd.randrange(8)}", 1, 0, 0) for d in rnd.choices(range(140), k=90)]
    schema = "log_date date, package_nm string, server_type long, os_type string, device_id string, visit_cnt long, install_cnt long, login_cnt long"
    access = spark.createDataFrame(rows, schema)
    page_schema = (
        "log_date date, package_nm string, server_type long, os_type string, crash_count long, error_count long, js_error_count long, "
        "log_count long, intervaltime long, lcp double, ttfb double, fcp double, inp double"
    )
    pages = spark.createDataFrame([], page_schema)
    start, end = first + dt.timedelta(days=20), first + dt.timedelta(days=201)
    got = {r.stat_date: (r.dau, r.revisit_7d, r.mau) for r in kpi.statistic_history(access, pages, start, end).collect()}
    dates = {}
    for r in rows:
        dates.setdefault(r[4], set()).add(r[0])
    for day in {r[0] for r in rows if start <= r[0] <= end}:
        now = [d for d in dates.values() if day in d]
        back = [d for d in now if any(dt.timedelta(0) < day - x <= dt.timedelta(7) for x in d)]
        month = [d for d in dates.values() if any(dt.timedelta(0) <= day - x <= dt.timedelta(30) for x in d)]
        assert got[day] == (len(now), len(back), len(month))
