"""Scalar functions and calendars against known values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranking, text
from tidemark.functions import timegrid as tg


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def lit(value, kind="string"):
    return F.lit(value).cast(kind)


def test_speed_class(spark):
    cases = [(None, 100, 4), (1000, 500, 0), (1000, 1000, 2), (1000, 2000, 4), (1000, 800, 1), (1000, 1200, 3)]
    rows = spark.createDataFrame(cases, "standard long, time long, want int")
    for r in rows.select("want", text.speed_class("time", "standard").alias("got")).collect():
        assert r.got == r.want


def test_masking(spark):
    r = one(
        spark, a=text.mask_range(lit("userabcd"), 4, 8), b=text.mask_user(lit("user"), 2), c=text.mask_user(lit("tester"), 2),
        d=text.mask_user(lit(None), 2), e=text.mask_user(lit(" "), 2), f=text.mask_range(lit("user"), 2, 8),
    )
    assert list(r) == ["user****", "us**", "te****", "-", "-", "user"]


def test_units(spark):
    r = one(
        spark, a=text.fmt_mem(lit(None), "kb"), b=text.fmt_mem(lit("1024"), "kb"), c=text.fmt_mem(lit(2048, "int"), "mb"),
        d=text.fmt_mem(lit(10, "int"), "unknown"), e=text.fmt_mem(lit("NaN"), "kb"),
        f=text.fmt_mem(lit("1024.5"), "kb"), g=text.fmt_mem(lit("many"), "kb"), h=text.fmt_mem(lit(" "), "kb"),
    )
    assert list(r) == ["0MB", "1.0MB", "2.0GB", "0GB", "0MB", "1.0MB", "0GB", "0MB"]


def test_bytes_and_times(spark):
    sizes = [(None, "0"), (0.0, "0 B"), (1023.0, "1023 B"), (1024.0, "1.0 KB"), (1.5 * 1024**2, "1.5 MB"), (3.0 * 1024**3, "3.0 GB")]
    rows = spark.createDataFrame(sizes, "size double, want string")
    assert all(r.got == r.want for r in rows.select("want", text.fmt_bytes("size").alias("got")).collect())
    times = [(None, "0ms"), (-1, "0ms"), (999, "999ms"), (1500, "1s"), (65_000, "1m 5s"), (7_200_000, "2h")]
    rows = spark.createDataFrame(times, "ms long, want string")
    assert all(r.got == r.want for r in rows.select("want", text.fmt_ms("ms").alias("got")).collect())
    r = one(spark, a=text.fmt_ms(lit(1500, "long"), decimals=True), b=text.fmt_ms(lit(2000, "long"), decimals=True), c=text.fmt_ms(lit(65_000, "long"), detail=False))
    assert list(r) == ["1.5s", "2s", "1m"]


def test_network_names(spark):
    cases = [("1", "WiFi"), ("2", "2G"), ("5", "5G"), (None, "ETC"), ("abc", "ETC"), ("wifi", "WiFi"), ("4G", "LTE"), ("9", "ETC")]
    rows = spark.createDataFrame(cases, "code string, want string")
    assert all(r.got == r.want for r in rows.select("want", text.normalise_network("code").alias("got")).collect())


def test_hash_of_blank_is_null(spark):
    r = one(spark, a=text.hash_key(lit(None)), b=text.hash_key(lit("")), c=text.hash_key(lit("   ")), d=text.hash_key(lit("x"), "32"))
    assert list(r)[:3] == [None, None, None] and len(r.d) == 8


def test_first_line(spark):
    r = one(spark, a=text.first_line(lit("a\r\nb")), b=text.first_line(lit("")), c=text.first_line(lit(None)), d=text.first_line(lit("\nx")))
    assert list(r) == ["a", None, None, None]


def test_calendar(spark):
    days = tg.calendar(spark, dt.date(2023, 12, 1), dt.date(2023, 12, 3)).collect()
    assert [r.bucket for r in days] == [dt.date(2023, 12, d) for d in (1, 2, 3)]
    assert tg.calendar(spark, dt.date(2023, 1, 15), dt.date(2023, 3, 2), "month").count() == 3
    assert tg.calendar(spark, dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 1, 23), "hour").count() == 24
    with pytest.raises(ValueError):
        tg.calendar(spark, dt.date(2023, 4, 1), dt.date(2023, 3, 1))


def test_adaptive_width():
    assert tg.adaptive_width(0, 6 * tg.HOUR) == tg.MINUTE
    assert tg.adaptive_width(0, 24 * tg.HOUR) == 5 * tg.MINUTE
    assert tg.adaptive_width(0, 25 * tg.HOUR) == tg.HOUR


def test_day_in_a_zone(spark):
    ms = tg.millis(dt.datetime(2024, 1, 1, 20))
    r = one(spark, a=tg.day_of(F.lit(ms)), b=tg.day_of(F.lit(ms), "Asia/Seoul"))
    assert (r.a, r.b) == (dt.date(2024, 1, 1), dt.date(2024, 1, 2))


def test_zero_fill_keeps_null_for_columns_without_default(spark):
    df = spark.createDataFrame([("a", 60_000, 5)], "k string, bucket long, n long")
    rows = tg.zero_fill(df, "bucket", tg.ms_steps(0, 180_000, 60_000), {"n": 0}, ["k"]).orderBy("bucket").collect()
    assert [(r.bucket, r.n) for r in rows] == [(0, 0), (60_000, 5), (120_000, 0)]


def test_keyset_pages_cover_everything_once(spark):
    rows = [(t % 5, f"d{t % 3}", t) for t in range(60)]
    df = spark.createDataFrame(rows, "a long, b string, c long")
    order, after, seen = [("a", True), ("b", False), ("c", True)], None, []
    while got := ranking.keyset_page(df, order, 7, after).collect():
        seen += [tuple(r) for r in got]
        after = seen[-1]
    assert sorted(seen) == sorted(rows) and len(seen) == 60


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_with_and_without_salts(spark, n):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 5003).alias("v"), "id")
    got = ranking.top_n(df, ["k"], [F.col("v").desc(), "id"], n).collect()
    for k in (0, 1):
        want = sorted(((i * 7919 % 5003, -i) for i in range(5000) if i % 2 == k), reverse=True)[:n]
        assert sorted(((r.v, -r.id) for r in got if r.k == k), reverse=True) == want
