"""KPI series, cards, counters and top lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import with_overall
from tidemark.operators.common import DIMS, count_rows, mean, on_day, sums
from tidemark.operators.rollup import merge_on_dims


def visit_totals(access: DataFrame, day: dt.date) -> DataFrame:
    """Visits, installs and logins of a day by app."""
    return on_day(access, day).groupBy(*DIMS).agg(
        F.sum("visit_cnt").alias("visit"), F.sum("install_cnt").alias("install"), F.sum("login_cnt").alias("login")
    )


def active_users(access: DataFrame, day: dt.date) -> DataFrame:
    """DAU, 7-day revisits and MAU (31 dates) of the apps seen on the day.

    Each device is first reduced to three flags, then the flags are summed: one scan, no joins.
    """
    date = F.col("log_date")
    flags = (
        access.filter(date.between(F.lit(day - dt.timedelta(days=30)), F.lit(day)))
        .groupBy(*DIMS, "device_id")
        .agg(
            F.bool_or(date == F.lit(day)).alias("d"),
            F.bool_or((date >= F.lit(day - dt.timedelta(days=7))) & (date < F.lit(day))).alias("w"),
        )
    )
    return (
        flags.groupBy(*DIMS)
        .agg(
            F.count_if("d").alias("dau"),
            F.count_if(F.col("d") & F.col("w")).alias("revisit_7d"),
            count_rows("mau"),
        )
        .filter("dau > 0")
    )


def active_users_bitmap(bitmaps: DataFrame, day: dt.date) -> DataFrame:
    """The same from stored bitmaps. The revisit overlap is |today| + |week| - |either|."""
    date = F.col("log_date")
    today = date == F.lit(day)
    week = (date >= F.lit(day - dt.timedelta(days=7))) & (date < F.lit(day))
    rows = bitmaps.filter(date.between(F.lit(day - dt.timedelta(days=30)), F.lit(day)))

    def members(cond):
        return F.bitmap_or_agg(F.when(cond, F.col("users")))

    blocks = rows.groupBy(*DIMS, "block").agg(
        members(today).alias("d"), members(week).alias("w"), members(today | week).alias("e"),
        F.bitmap_or_agg("users").alias("m"),
    )

    def size(col):
        return F.coalesce(F.sum(F.bitmap_count(col)), F.lit(0))

    return (
        blocks.groupBy(*DIMS)
        .agg(size("d").alias("dau"), (size("d") + size("w") - size("e")).alias("revisit_7d"), size("m").alias("mau"))
        .filter("dau > 0")
    )


def page_kpis(pages: DataFrame, day: dt.date) -> DataFrame:
    """Trouble sums, mean stay and vitals and page views of a day by app."""
    return on_day(pages, day).groupBy(*DIMS).agg(
        *sums("crash_count", "error_count", "js_error_count", "log_count"),
        mean("intervaltime", "intervaltime_avg"), mean("lcp", "lcp_avg"), mean("ttfb", "ttfb_avg"),
        mean("fcp", "fcp_avg"), mean("inp", "inp_avg"), count_rows("pv"),
    )


def merge_kpis(visits: DataFrame, users: DataFrame, *more: DataFrame, stamp: bool = False) -> DataFrame:
    """Visit, user and page KPIs on one row per app, zero where a side is missing."""
    merged = merge_on_dims(users, visits, *more)
    return merged.withColumn("updated_at", F.current_timestamp()) if stamp else merged


def statistic_history(access: DataFrame, pages: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """device_statistic for every day of a range in one job.

    A device's dates are made distinct and looked at in order, at most one row per day. A date revisits
    when the one before is at most 7 days back. It keeps the device in the MAU for 31 days: a device
    enters when its last such stretch is over, leaves when no date follows in time, and the MAU is the
    running total of both. No date is copied to the days it counts for.
    """
    seen = access.filter(F.col("log_date").between(F.lit(start - dt.timedelta(days=30)), F.lit(end)))
    per_device = Window.partitionBy(*DIMS, "device_id").orderBy("log_date")
    days = (
        seen.select(*DIMS, "device_id", "log_date").distinct()
        .withColumn("_back", F.date_diff("log_date", F.lag("log_date").over(per_device)))
        .withColumn("_ahead", F.date_diff(F.lead("log_date").over(per_device), "log_date"))
    )
    enters = F.coalesce(F.col("_back") > 30, F.lit(True))
    leaves = F.coalesce(F.col("_ahead") > 30, F.lit(True))
    zero = F.lit(0).cast("long")
    came = days.groupBy(*DIMS, F.col("log_date").alias("stat_date")).agg(
        count_rows("dau"), F.count_if(F.col("_back") <= 7).alias("revisit_7d"), F.count_if(enters).alias("_in"),
        F.count_if(leaves).alias("_out"),
    )
    gone = came.select(*DIMS, F.date_add("stat_date", 31).alias("stat_date"), zero.alias("dau"), zero.alias("revisit_7d"), (-F.col("_out")).alias("_move"))
    moves = came.withColumn("_move", F.col("_in")).drop("_in", "_out").unionByName(gone)
    daily = moves.groupBy(*DIMS, "stat_date").agg(*[F.sum(c).alias(c) for c in ("dau", "revisit_7d", "_move")])
    # One row per app and day from here on.
    upto = Window.partitionBy(*DIMS).orderBy("stat_date").rowsBetween(Window.unboundedPreceding, 0)
    users = (
        daily.withColumn("mau", F.sum("_move").over(upto)).drop("_move")
        .filter((F.col("dau") > 0) & tg.in_days("stat_date", start, end))
    )
    visits = access.filter(tg.in_days("log_date", start, end)).groupBy(F.col("log_date").alias("stat_date"), *DIMS).agg(
        F.sum("visit_cnt").alias("visit"), F.sum("install_cnt").alias("install"), F.sum("login_cnt").alias("login")
    )
    page = pages.filter(tg.in_days("log_date", start, end)).groupBy(F.col("log_date").alias("stat_date"), *DIMS).agg(
        *sums("crash_count", "error_count", "js_error_count", "log_count"),
        mean("intervaltime", "intervaltime_avg"), mean("lcp", "lcp_avg"), mean("ttfb", "ttfb_avg"),
        mean("fcp", "fcp_avg"), mean("inp", "inp_avg"), count_rows("pv"),
    )
    merged = visits.join(users, ["stat_date", *DIMS], "full").join(page, ["stat_date", *DIMS], "full")
    counters = ["visit", "install", "login", "dau", "revisit_7d", "mau", "crash_count", "error_count",
                "js_error_count", "log_count", "pv"]
    means = ["intervaltime_avg", "lcp_avg", "ttfb_avg", "fcp_avg", "inp_avg"]
    return merged.fillna(0, counters).fillna(0.0, means)


def metric_series(stat: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Daily sums (mean stay for ``intervaltime_avg``) by day and OS."""
    return stat.filter(tg.in_days("stat_date", start, end)).groupBy("stat_date", "os_type").agg(
        *sums("install", "login", "dau", "revisit_7d", "mau", "pv"),
        mean("intervaltime_avg", "intervaltime_avg", 8),
        *sums("log_count", "error_count", "js_error_count", "crash_count"),
    )


def install_series(stat: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return stat.filter(tg.in_days("stat_date", start, end)).groupBy("stat_date", "os_type").agg(*sums("install"))


def mau_monthly(stat: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Largest daily MAU of each month by OS."""
    return (
        stat.filter(tg.in_days("stat_date", start, end))
        .groupBy(F.trunc("stat_date", "month").alias("stat_month"), "os_type")
        .agg(F.max("mau").alias("mau"))
    )


def overview(daily: DataFrame, start: dt.date, end: dt.date, limit: int) -> DataFrame:
    """Page views, users and error rate by day."""
    return (
        daily.filter(tg.in_days("log_date", start, end))
        .select("log_date", "pv", "uv", F.round("error_rate", 4).alias("error_rate"))
        .orderBy("log_date")
        .limit(limit)
    )


def daily_overview(pages: DataFrame) -> DataFrame:
    """Per day page views, distinct devices and errors per page view."""
    return pages.groupBy("log_date").agg(
        count_rows("pv"), F.count_distinct("device_id").alias("uv"),
        (F.sum(F.col("error_count") + F.col("crash_count")) / F.count(F.lit(1))).alias("error_rate"),
    )


def zero_fill_series(
    series: DataFrame, value: str, start: dt.date, end: dt.date, grain: str = "day",
    date: str = "stat_date", os_names: Sequence[str] = ("Android", "iOS"),
) -> DataFrame:
    """One row per day or month from the later of the request and the first data, a column per OS.

    The first data day is found inside the plan, so nothing is pulled to the driver.
    """
    wanted = [o.lower() for o in os_names]
    known = series.withColumn("_os", F.lower(F.trim("os_type"))).filter(F.col("_os").isin(*wanted))
    low, high = F.lit(start), F.lit(end)
    if grain == "month":
        low, high = F.trunc(low, "month"), F.trunc(high, "month")
    first = F.least(F.greatest(F.coalesce(F.min(date), low), low), high)
    step = F.expr("INTERVAL 1 MONTH" if grain == "month" else "INTERVAL 1 DAY")
    days = known.agg(first.alias("_first")).select(F.explode(F.sequence(F.col("_first"), high, step)).alias(date))
    split = known.groupBy(date).agg(
        *[F.sum(F.when(F.col("_os") == o, F.col(value))).alias(f"{o}_{value}") for o in wanted]
    )
    names = [f"{o}_{value}" for o in wanted]
    return days.join(split, date, "left").fillna(0, names)


def clamp_selected(series: DataFrame, selected: dt.date, date: str = "stat_date") -> DataFrame:
    """The row of a selected day, moved into the series when it lies outside."""
    bounds = series.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    day = F.least(F.greatest(F.lit(selected), F.col("lo")), F.col("hi"))
    return series.join(bounds.select(day.alias(date)), date, "left_semi")


CARD = ("install", "android", "ios", "mau", "ccu", "pv", "revisit", "sleep", "login", "stay", "log", "error", "crash", "dau")


def kpi_card(stat: DataFrame, day: dt.date, os_type: str | None = None) -> DataFrame:
    """Fourteen KPIs of today and yesterday; error adds script errors; OS shares are whole percents of DAU."""
    rows = stat.filter(tg.in_days("stat_date", day - dt.timedelta(days=1), day))
    rows = rows.filter(F.lower("os_type").isin("android", "ios"))
    wanted = F.lit(True) if os_type is None else F.col("os_type") == os_type
    source = {
        "install": "install", "mau": "mau", "pv": "pv", "revisit": "revisit_7d", "login": "login",
        "stay": "intervaltime_avg", "log": "log_count", "error": "error_count + js_error_count",
        "crash": "crash_count", "dau": "dau",
    }
    sides = {"t": F.col("stat_date") == F.lit(day), "y": F.col("stat_date") < F.lit(day)}

    def total(expr, cond):
        return F.coalesce(F.sum(F.when(cond, F.expr(expr))), F.lit(0)).cast("double").cast("long")

    def dau(os_name):
        return F.coalesce(F.sum(F.when(sides["t"] & (F.lower("os_type") == os_name), F.col("dau"))), F.lit(0))

    packed = rows.agg(
        *[total(e, c & wanted).alias(f"{k}_{s}") for k, e in source.items() for s, c in sides.items()],
        F.when(dau("android") + dau("ios") > 0, F.floor(dau("android") * 100.0 / (dau("android") + dau("ios"))))
        .otherwise(0).cast("long").alias("_share"),
    )
    zero = F.lit(0).cast("long")
    items = []
    for i, name in enumerate(CARD):
        if name in source:
            today, yesterday = F.col(f"{name}_t"), F.col(f"{name}_y")
        elif name in ("android", "ios"):
            today, yesterday = (F.col("_share") if name == "android" else 100 - F.col("_share")), zero
        else:
            today, yesterday = zero, zero
        items.append(F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), today.alias("today"), yesterday.alias("yesterday")))
    return packed.select(F.inline(F.array(*items)))


def trouble_counts(trouble: DataFrame, by: Sequence[str]) -> DataFrame:
    """Crash rows and other rows per group."""
    return trouble.groupBy(*by).agg(
        F.count_if(F.col("log_type") == lt.CRASH).alias("crash_count"),
        F.count_if(F.col("log_type") != lt.CRASH).alias("error_count"),
    )


def trouble_stackmax(trouble: DataFrame, day: dt.date, days: int = 7) -> DataFrame:
    """Mean crashes and errors a day over the days before, and their ceilings as chart bounds."""
    start, end = day - dt.timedelta(days=days), day - dt.timedelta(days=1)
    daily = trouble_counts(trouble.filter(tg.in_days("log_date", start, end)), ["log_date", "package_nm", "server_type"])
    return daily.groupBy("package_nm", "server_type").agg(
        *[F.round(F.sum(f"{k}_count") / days, 4).alias(f"avg_{k}") for k in ("crash", "error")],
        *[F.ceil(F.sum(f"{k}_count") / days).cast("long").alias(f"stack_max_{k}") for k in ("crash", "error")],
    )


def trouble_today(trouble: DataFrame, day: dt.date) -> DataFrame:
    return trouble_counts(on_day(trouble, day), ["package_nm", "server_type"])


def snapshot_delta(
    snapshots: DataFrame, keys: Sequence[str], at: str, counters: Sequence[str]
) -> DataFrame:
    """Growth of running counters since the previous snapshot of the key, never below 0.

    A key has one row per snapshot, so the window per key is bounded by time, not by events.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    previous = {c: F.coalesce(F.lag(c).over(order), F.lit(0)) for c in counters}
    return snapshots.select(
        "*", *[F.greatest(F.lit(0), F.col(c) - p).cast("long").alias(f"{c}_delta") for c, p in previous.items()]
    )


def incremental_counts(
    events: DataFrame, cursor: dt.datetime | None, now: dt.datetime, ts: str = "reg_dt", look_back_s: int = 10
) -> DataFrame:
    """Rows after the cursor by package and server, with the newest arrival as the next cursor."""
    start = cursor if cursor is not None else now - dt.timedelta(seconds=look_back_s)
    fresh = events.filter(F.col(ts) > F.lit(start)).filter("package_nm != '' AND server_type IS NOT NULL")
    return fresh.groupBy("package_nm", "server_type").agg(count_rows("log_count"), F.max(ts).alias("last_reg_dt"))


def top_n_other(df: DataFrame, key: str, count: str, n: int = 10, other: str = "Other") -> DataFrame:
    """The n largest keys with their share of the total; what remains comes last as one row."""
    totals = df.groupBy(key).agg(F.sum(count).alias("cnt"))
    top = with_overall(totals.orderBy(F.col("cnt").desc(), F.col(key)).limit(n), totals, {"_all": F.sum("cnt")})
    rest = top.agg((F.max("_all") - F.sum("cnt")).alias("cnt"), F.max("_all").alias("_all")).filter("cnt > 0")
    both = top.withColumn("is_other", F.lit(0)).unionByName(
        rest.select(F.lit(other).alias(key), "cnt", "_all", F.lit(1).alias("is_other"))
    )
    rate = F.round(F.col("cnt") * 100.0 / F.col("_all"), 4).alias("rate")
    return both.select(key, "cnt", rate, "is_other").orderBy("is_other", F.col("cnt").desc(), key)


def web_bi(pages: DataFrame, trouble: DataFrame, access: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Per day web counts and mean vitals, every day of the range present."""
    in_range = tg.in_days("log_date", start, end)
    views = pages.filter(in_range).groupBy("log_date").agg(
        count_rows("count_pv"), F.count_distinct("device_id").alias("count_dau"), mean("intervaltime", "avg_use_time"),
        mean("lcp", "avg_lcp"), mean("inp", "avg_inp"), mean("cls", "avg_cls"), mean("fcp", "avg_fcp"), mean("ttfb", "avg_ttfb"),
    )
    errors = trouble.filter(in_range).groupBy("log_date").agg(count_rows("count_error"))
    new = access.filter(in_range).groupBy("log_date").agg(F.sum("install_cnt").alias("count_new"))
    spark = pages.sparkSession
    days = tg.calendar(spark, start, end, "day", "log_date")
    joined = days.join(views, "log_date", "left").join(errors, "log_date", "left").join(new, "log_date", "left")
    return joined.fillna(0, ["count_pv", "count_dau", "count_error", "count_new"])


def web_bi_months(stat: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Largest daily MAU of each month over all rows of the ``front`` OS, or of every OS given."""
    return stat.filter(tg.in_days("stat_date", start, end)).groupBy(
        F.trunc("stat_date", "month").alias("base_month")
    ).agg(F.max("mau").alias("mau"))


def concurrent_users(events: DataFrame, ts: str = "log_tm") -> DataFrame:
    """Distinct devices per minute."""
    return events.groupBy(tg.bucket_ms(ts, tg.MINUTE).alias("minute_ms")).agg(F.count_distinct("device_id").alias("ccu"))


def ccu_day(series: DataFrame, day: dt.date) -> DataFrame:
    """The minutes of a day, 0 where nobody was connected."""
    start = tg.millis(day)
    inside = series.filter((F.col("minute_ms") >= start) & (F.col("minute_ms") < start + tg.DAY))
    return tg.zero_fill(inside, "minute_ms", tg.ms_steps(start, start + tg.DAY, tg.MINUTE), {"ccu": 0})


def ccu_peaks(series: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Highest minute of each day and, on every row, of the whole range."""
    days = series.withColumn("log_date", tg.day_of("minute_ms")).filter(tg.in_days("log_date", start, end))
    daily = days.groupBy("log_date").agg(F.max("ccu").alias("max_ccu"))
    filled = tg.zero_fill(daily, "log_date", tg.day_steps(start, end), {"max_ccu": 0})
    return filled.withColumn("peak", daily.agg(F.max("max_ccu")).scalar())


def avg_daily_count(df: DataFrame, by: Sequence[str] = (), distinct: str | None = None) -> DataFrame:
    """Mean over days of the daily row or distinct count."""
    each = count_rows("n") if distinct is None else F.count_distinct(distinct).alias("n")
    daily = df.groupBy("log_date", *by).agg(each)
    return daily.groupBy(*by).agg(F.round(F.avg("n"), 6).alias("avg_count"), count_rows("days"))


def count_pack(events: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Page views, errors and crashes of the range, the day before, the last 7 days and all time, in one pass.

    The day before is left out (NULL) unless the range is a single day.
    """
    one_day = start == end
    date = F.col("log_date")
    ranges = {
        "range": date.between(F.lit(start), F.lit(end)),
        "yesterday": date == F.lit(start - dt.timedelta(days=1)) if one_day else None,
        "week": date.between(F.lit(end - dt.timedelta(days=6)), F.lit(end)),
        "total": F.lit(True),
    }
    kinds = {"pv": lt.WEB_PAGE, "error": lt.ERROR, "crash": (lt.CRASH,)}
    cols = []
    for kind, types in kinds.items():
        of_kind = F.col("log_type").isin(*types)
        for name, cond in ranges.items():
            value = F.lit(None).cast("long") if cond is None else F.count_if(of_kind & cond)
            cols.append(value.alias(f"{kind}_{name}"))
    return events.groupBy("package_nm", "server_type").agg(*cols)


def multi_app_summary(stat: DataFrame, apps: DataFrame, day: dt.date) -> DataFrame:
    """Connect, crash, error and MAU counters of the day for each app of each user."""
    mine = apps.select("user_no", "package_nm", "server_type").distinct()
    totals = stat.filter(F.col("stat_date") == F.lit(day)).groupBy("package_nm", "server_type").agg(
        F.sum("dau").alias("connect"), F.sum("crash_count").alias("crash"),
        F.sum(F.col("error_count") + F.col("js_error_count")).alias("error"), F.sum("mau").alias("mau"),
    )
    return mine.join(totals, ["package_nm", "server_type"])
