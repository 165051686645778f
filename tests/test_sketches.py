"""Sketches beside exact answers: how far off they are, and that stored ones merge to the same."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import kpi, sketches
from tidemark.operators.common import DIMS

POINTS = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p999": 0.999}


@pytest.mark.parametrize(("value", "kind"), [("cast(pow(rand(1), 6) * 1e6 AS bigint)", "bigint"), ("exp(9 * rand(2))", "double")])
def test_ranks_of_merged_quantiles(spark, tmp_path, value, kind):
    rows = spark.range(300_000).selectExpr(f"{value} AS v", "1704067200000 + id * 1000 AS page_start_tm", "if(id % 10 = 0, 'cold', 'hot') AS package_nm")
    rows = rows.unionByName(rows.limit(5).withColumn("v", F.lit(None).cast(kind)))
    sketches.hourly_quantiles(rows, ["package_nm"], "v").write.parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    assert stored.groupBy("package_nm").count().filter("count < 80").count() == 0
    for r in sketches.range_quantiles(stored, ["package_nm"], POINTS, kind == "double").collect():
        own = rows.filter((F.col("package_nm") == r.package_nm) & F.col("v").isNotNull())
        assert r.n == own.count()
        for name, p in POINTS.items():
            below, upto = own.agg(F.avg((F.col("v") < r[name]).cast("double")), F.avg((F.col("v") <= r[name]).cast("double"))).first()
            assert below - 0.015 <= p <= upto + 0.015


def access(spark, n):
    """Devices that come on three days of a month, some of them on more."""
    days = F.expr("explode(array(id % 30, (id * 7) % 30, if(id % 3 = 0, 29, (id * 11) % 30)))").alias("day")
    rows = spark.range(n).select(F.concat(F.lit("d"), "id").alias("device_id"), days).distinct()
    return rows.select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("day").cast("int")).alias("log_date"), F.lit("p").alias("package_nm"), F.lit(0).alias("server_type"), F.lit("Web").alias("os_type"), "device_id",
    )


@pytest.mark.parametrize(("n", "off"), [(9000, 0.0), (120_000, 0.03)])
def test_users_from_daily_sets(spark, n, off):
    rows, day = access(spark, n), dt.date(2024, 1, 30)
    near = sketches.active_users_sketch(sketches.daily_devices(rows), day).first()
    exact = kpi.active_users(rows, day).first()
    assert abs(near.dau - exact.dau) <= off * exact.dau and abs(near.mau - exact.mau) <= off * exact.mau
    assert abs(near.revisit_7d - exact.revisit_7d) <= off * exact.mau and exact.revisit_7d > 0
    start, end = dt.date(2024, 1, 15), dt.date(2024, 1, 21)
    near = sketches.range_users_sketch(sketches.daily_devices(rows), start, end).first()
    now = rows.filter(F.col("log_date").between(F.lit(start), F.lit(end))).select("device_id").distinct()
    then = rows.filter(F.col("log_date").between(F.lit(start - dt.timedelta(days=7)), F.lit(start - dt.timedelta(days=1)))).select("device_id").distinct()
    users, returned = now.count(), now.join(then, "device_id", "left_semi").count()
    assert abs(near.users - users) <= off * users and abs(near.returned - returned) <= off * n and returned > 0


def test_days_without_the_app_give_no_row(spark):
    rows = access(spark, 50).filter("log_date < '2024-01-10'")
    assert sketches.active_users_sketch(sketches.daily_devices(rows), dt.date(2024, 1, 20)).count() == 0
    assert sketches.daily_devices(rows).columns == ["log_date", *DIMS, "devices"]


def test_heavy_hitters_of_skewed_messages(spark, tmp_path):
    """Far more messages than a state holds: the top ones are there, and no count is off by more than the bound."""
    tracked, n = 512, 200_000
    rows = spark.range(n).selectExpr(
        "concat('m', cast(floor(pow((id * 7919 % 200000) / 200000.0, 5) * 20000) AS int)) AS log_name", "1704067200000 + id * 500 AS log_tm", "if(id % 3 = 0, 'a', 'b') AS package_nm",
    )
    rows = rows.unionByName(rows.limit(9).withColumn("log_name", F.lit(None).cast("string")))
    sketches.hourly_hitters(rows, "log_name", ["package_nm"], tracked=tracked).write.parquet(str(tmp_path / "h"))
    found = sketches.range_hitters(spark.read.parquet(str(tmp_path / "h")), "log_name", ["package_nm"], 10, tracked).collect()
    for package in ("a", "b"):
        exact = {r.log_name: r["count"] for r in rows.filter(F.col("package_nm") == package).groupBy("log_name").count().collect() if r.log_name}
        bound = 3.5 / tracked * sum(exact.values())
        got = sorted((r for r in found if r.package_nm == package), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert all(abs(r.cnt - exact[r.log_name]) <= bound for r in got)
        sure = {m for m, c in exact.items() if c > sorted(exact.values())[-11] + bound}
        assert sure and sure <= {r.log_name for r in got}


def test_a_state_that_holds_all_is_exact(spark):
    rows = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("z", 3), ("z", 4), (None, 5)], "log_name string, log_tm long")
    got = sketches.range_hitters(sketches.hourly_hitters(rows, "log_name"), "log_name", n=2).collect()
    assert [(r.log_name, r.cnt, r.share, r.rank) for r in got] == [("x", 2, 40.0, 1), ("z", 2, 40.0, 2)]
