"""Page visits, sessions, flows and the lists of user analysis.

Everything that needs the order of a device's rows goes through SegmentedScan, so a device with very
many rows is cut by time and never sits in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.functions.ranking import keyset_page, top_n, with_overall
from tidemark.functions.segmented import SegmentedScan
from tidemark.operators.common import between_ms, count_rows, mean, sums

# Types that end the page before them; a crash is counted but opens no page.
PAGE_OPENERS = (
    lt.APP_FIRST_START, lt.WEB_START, lt.NATIVE_PAGE_START, lt.APP_START, lt.APP_FOREGROUND, lt.APP_BACKGROUND, lt.APP_TERMINATE,
)
REQUESTS = (lt.HTTP_REQUEST, 8388609)
SLICE = 10 * tg.MINUTE


def time_slice(ts_ms: str, width: int = SLICE) -> Column:
    return F.floor(F.col(ts_ms) / width)


def build_pages(
    events: DataFrame, carry: Sequence[str] = ("package_nm", "server_type", "os_type", "app_ver", "device_model", "user_id"),
    order: Sequence[str] = ("log_tm", "event_id"), openers: Sequence[int] = PAGE_OPENERS, width: int = SLICE,
) -> DataFrame:
    """Fold each device's ordered events into page rows.

    Every opener starts a page; the page number is the running count of openers. Events before a
    device's first page belong to none.
    """
    kind = F.col("log_type")
    opens = kind.isin(*openers)
    numbered = (
        SegmentedScan(events, ["device_id"], order, time_slice("log_tm", width))
        .running_sum("page_no", F.when(opens, 1).otherwise(0))
        .done()
        .filter("page_no > 0")
    )
    counted = kind != lt.RESOURCE_START

    def opener(col: str) -> Column:
        return F.max(F.when(opens, F.col(col))).alias(col)

    start = F.max(F.when(opens, F.col("log_tm")))
    finish = F.max(F.when(kind.isin(lt.WEB_END, lt.NATIVE_PAGE_END), F.col("log_tm")))
    usage = [
        F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).cast("long").alias(f"sum_{c}")
        for c in ("cpu_usage", "mem_usage")
        if c in events.columns
    ]
    pages = numbered.groupBy("device_id", "page_no").agg(
        *[opener(c) for c in (*carry, "req_url", "log_type")],
        start.alias("page_start_tm"),
        F.max("log_tm").alias("page_end_tm"),
        (F.max("log_tm") - start).alias("intervaltime"),
        F.coalesce(F.greatest(finish - start, F.lit(0)), F.lit(0)).cast("long").alias("loading_time"),
        F.count_if(counted).alias("log_count"),
        F.count_if(counted).alias("event_count"),
        F.count_if(kind.isin(lt.SCRIPT_ERROR, lt.WEB_ERROR, lt.HTTP_ERROR)).alias("error_count"),
        F.count_if(kind == lt.SCRIPT_ERROR).alias("js_error_count"),
        F.count_if(kind == lt.CRASH).alias("crash_count"),
        F.count_if(kind.isin(*REQUESTS)).alias("request_count"),
        F.when(F.bool_or(kind.isin(*lt.WEBPERF)), "Y").otherwise("N").alias("wtf_flag"),
        *usage,
    )
    return pages.withColumn("log_date", tg.day_of("page_start_tm"))


def with_flow(
    pages: DataFrame, order: Sequence[str] = ("page_start_tm", "page_no"), app_start: int = lt.APP_START, width: int = SLICE
) -> DataFrame:
    """Session start, running flow order and the page before.

    An app start opens a session; pages before the first one belong to the session of the device's first
    page. The order counter runs on across sessions.
    """
    starts = F.when(F.col("log_type") == app_start, F.col("page_start_tm"))
    flowed = (
        SegmentedScan(pages, ["device_id"], order, time_slice("page_start_tm", width))
        .running_sum("flow_order", F.lit(1))
        .running_last("_session", starts)
        .lowest("_first", "page_start_tm")
        .lag("pre_url", "req_url")
        .lag("pre_url_time", "page_end_tm")
        .done()
    )
    return (
        flowed.withColumn("parent_log_date", F.coalesce("_session", "_first"))
        .withColumn("pre_url", F.coalesce("pre_url", F.lit("")))
        .withColumn("pre_url_time", F.coalesce("pre_url_time", F.lit(0).cast("long")))
        .drop("_session", "_first")
    )


def sessionize(
    pages: DataFrame, gap_ms: int = 30 * tg.MINUTE, starters: Sequence[int] = (lt.APP_FIRST_START,),
    ts: str = "page_start_tm", order: Sequence[str] = ("page_start_tm", "page_id"), width: int = SLICE, with_next: bool = False,
) -> DataFrame:
    """Sessions by idle gap or a starting type; flow order restarts in each session.

    ``with_next`` adds ``next_url``, the URL of the session's next page. One pass: rows are ordered inside (device, time slice), each slice is summed up in one row, the
    slices of a device settle whether their first row opens a session, and the result is joined back.
    """
    part = ["device_id", "_slice"]
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    last_row = F.struct(F.col(ts).alias("ts"), F.col("req_url").alias("url"), F.col("page_end_tm").alias("end"))
    starter = F.col("log_type").isin(*starters)
    prev = F.col("_prev")["ts"]
    # A slice's first row has no known predecessor yet, so only later rows can be settled here.
    settled = prev.isNotNull() & (starter | (F.col(ts) - prev > gap_ms))
    local = (
        pages.withColumn("_slice", time_slice(ts, width))
        .withColumn("_prev", F.lag(last_row).over(inside))
        .withColumn("_n", F.row_number().over(inside))
        .withColumn("_opened", F.last(F.when(settled, F.struct(F.col(ts).alias("ts"), F.col("_n").alias("n"))), ignorenulls=True).over(upto))
    )
    key = F.struct(*order)
    head_row = F.struct(F.col(ts).alias("ts"), F.col("req_url").alias("url"), starter.alias("starts"))
    if with_next:
        local = local.withColumn("_next", F.lead(head_row).over(inside))
    slices = local.groupBy(*part).agg(
        *([F.min_by(head_row, key).alias("_head_row")] if with_next else []),
        F.max_by(last_row, key).alias("_last"), F.min(ts).alias("_first_ts"),
        F.bool_or((F.col("_n") == 1) & starter).alias("_starts"), count_rows("_cnt"), F.max("_opened").alias("_last_open"),
    )
    earlier = Window.partitionBy("device_id").orderBy("_slice")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    settled_slices = (
        slices.withColumn("_carry", F.lag("_last").over(earlier))
        .withColumn("_prior", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
        .withColumn("_fresh", F.col("_starts") | F.col("_carry").isNull() | (F.col("_first_ts") - F.col("_carry")["ts"] > gap_ms))
        .withColumn("_head", F.when(F.col("_fresh"), F.struct(F.col("_first_ts").alias("ts"), (F.col("_prior") + 1).alias("n"))))
        .withColumn(
            "_tail",
            F.when(F.col("_last_open").isNull(), F.col("_head")).otherwise(
                F.struct(F.col("_last_open")["ts"].alias("ts"), (F.col("_prior") + F.col("_last_open")["n"]).alias("n"))
            ),
        )
        .withColumn("_open", F.coalesce("_head", F.last("_tail", ignorenulls=True).over(before)))
    )
    if with_next:
        settled_slices = settled_slices.withColumn("_carry_next", F.lead("_head_row").over(earlier))
    settled_slices = settled_slices.select(*part, "_carry", "_prior", "_open", *(["_carry_next"] if with_next else []))
    joined = local.join(settled_slices, part)
    previous = F.coalesce("_prev", "_carry")
    opened_at = F.coalesce(F.col("_opened")["ts"], F.col("_open")["ts"])
    base = F.coalesce(F.col("_prior") + F.col("_opened")["n"], F.col("_open")["n"])
    nexts = []
    if with_next:
        following = F.coalesce("_next", "_carry_next")
        same = ~following["starts"] & (following["ts"] - F.col(ts) <= gap_ms)
        nexts = [F.when(same, following["url"]).alias("next_url")]
    return joined.select(
        *pages.columns,
        opened_at.alias("parent_log_date"),
        (F.col("_prior") + F.col("_n") - base + 1).alias("flow_order"),
        F.coalesce(previous["url"], F.lit("")).alias("pre_url"),
        F.coalesce(previous["end"], F.lit(0).cast("long")).alias("pre_url_time"),
        *nexts,
    )


def event_timeline(
    events: DataFrame, start_ms: int, end_ms: int, limit: int, device: str | None = None, page_url: str | None = None,
    order: Sequence[str] = ("log_tm", "event_id"),
) -> DataFrame:
    """First events of each device in a range; the alias is the request URL, else the page URL."""
    rows = between_ms(events, "log_tm", start_ms, end_ms)
    if device is not None:
        rows = rows.filter(F.col("device_id") == device)
    if page_url is not None:
        rows = rows.filter(F.col("page_url") == page_url)
    fallback = F.col("page_url") if "page_url" in events.columns else F.lit(None).cast("string")
    rows = rows.withColumn("alias", F.coalesce(F.nullif(F.trim("req_url"), F.lit("")), fallback))
    return top_n(rows, ["device_id"], order, limit)


def session_pages(pages: DataFrame, n: int, offset: int = 0, device: str | None = None) -> DataFrame:
    """Every page of the newest n sessions of each device, after skipping ``offset`` of them."""
    if device is not None:
        pages = pages.filter(F.col("device_id") == device)
    sessions = pages.filter("parent_log_date > 0").select("device_id", "parent_log_date").distinct()
    newest = top_n(sessions, ["device_id"], [F.col("parent_log_date").desc()], n + offset, rank="_rank")
    chosen = newest.filter(F.col("_rank") > offset).drop("_rank")
    return pages.join(chosen, ["device_id", "parent_log_date"], "left_semi")


def search_filter(df: DataFrame, search: Mapping[str, str], prefix: bool = False) -> DataFrame:
    """Rows where any of the given fields equals, or starts with, its value."""
    if not search:
        return df
    found = F.lit(False)
    for name, value in search.items():
        found = found | (F.col(name).startswith(value) if prefix else F.col(name) == value)
    return df.filter(F.coalesce(found, F.lit(False)))


def page_flow(pages: DataFrame, search: Mapping[str, str] | None = None) -> DataFrame:
    """Pages with their session's bounds and size, for showing sessions newest first, pages ascending.

    Sessions stay rows, they are not collected into arrays, so their size does not matter.
    """
    rows = search_filter(pages, search or {})
    heads = rows.groupBy("device_id", "parent_log_date").agg(
        F.min("page_start_tm").alias("session_start"), F.max("page_end_tm").alias("session_end"), count_rows("session_pages"),
    )
    return rows.join(heads, ["device_id", "parent_log_date"])


# Slice widths of ``session_at``: each 32 times the one before, from an hour; the widest holds any two epoch times.
_WIDTHS = [tg.HOUR * 32**i for i in range(9)]


def session_at(pages: DataFrame, points: DataFrame) -> DataFrame:
    """Pages of the device whose [start, end] holds a time.

    A page is listed under the slices it touches of the least width that is not under its length, two at most however long it is, and
    joined on (device, width, slice), so the range test runs inside an equi join. A time is looked up once a width.
    """
    span, lengths = F.col("page_end_tm") - F.col("page_start_tm"), F.lit(_WIDTHS[-1])
    for width in reversed(_WIDTHS[:-1]):
        lengths = F.when(span <= width, F.lit(width)).otherwise(lengths)
    held = pages.filter("page_end_tm >= page_start_tm").withColumn("_width", lengths.cast("long"))
    first, last = (F.expr(f"page_{end}_tm div _width") for end in ("start", "end"))
    held = held.withColumn("_slice", F.explode(F.array_distinct(F.array(first, last))))
    asked = points.select("device_id", "at_ms", F.explode(F.array(*[F.lit(w) for w in _WIDTHS])).alias("_width"))
    asked = asked.withColumn("_slice", F.expr("at_ms div _width"))
    inside = asked.join(held, ["device_id", "_width", "_slice"]).filter("page_start_tm <= at_ms AND page_end_tm >= at_ms")
    return inside.drop("_width", "_slice")


def _latest(col: str, order: Sequence[str], name: str | None = None) -> Column:
    return F.max_by(col, F.struct(*order)).alias(name or col)


def active_user_list(
    pages: DataFrame, start_ms: int, end_ms: int, limit: int, order: Sequence[str] = ("page_start_tm", "page_id")
) -> DataFrame:
    """Devices of a range: last seen values, totals and sessions, newest first."""
    rows = between_ms(pages, "page_start_tm", start_ms, end_ms)
    per_device = rows.groupBy("device_id").agg(
        *[_latest(c, order) for c in ("package_nm", "os_type", "device_model")],
        F.max("page_start_tm").alias("last_seen"),
        *sums("intervaltime", "request_count", "error_count", "crash_count"),
        F.count_distinct("parent_log_date").alias("sessions"),
    )
    return per_device.orderBy(F.col("last_seen").desc(), "device_id").limit(limit)


def user_list(
    pages: DataFrame, limit: int, search: Mapping[str, str] | None = None, prefix: bool = False,
    order: Sequence[str] = ("page_start_tm", "page_id"),
) -> DataFrame:
    """Latest row of every device and user, the most recent first."""
    rows = search_filter(pages, search or {}, prefix)
    latest = rows.groupBy("device_id", "user_id").agg(
        *[_latest(c, order) for c in ("package_nm", "os_type", "device_model", "app_ver", "req_url")],
        F.max("page_start_tm").alias("last_time"),
    )
    return latest.orderBy(F.col("last_time").desc(), "device_id", "user_id").limit(limit)


def total_users(pages: DataFrame, devices: int, users: int) -> DataFrame:
    """The most recent devices with latest session, total stay and their latest users.

    Devices are cut to the list first, and users to ``users`` per device, before any list is built.
    """
    per_device = pages.groupBy("device_id").agg(
        F.max("parent_log_date").alias("latest_session"), *sums("intervaltime")
    )
    listed = per_device.orderBy(F.col("latest_session").desc(), "device_id").limit(devices)
    per_user = (
        pages.join(listed.select("device_id"), "device_id", "left_semi")
        .filter("user_id IS NOT NULL")
        .groupBy("device_id", "user_id").agg(F.max("page_start_tm").alias("at"))
    )
    kept = top_n(per_user, ["device_id"], [F.col("at").desc(), "user_id"], users, rank="rn")
    names = kept.groupBy("device_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "user_id"))), lambda s: s["user_id"]).alias("users")
    )
    return listed.join(names, "device_id", "left")


def user_detail(
    pages: DataFrame, access: DataFrame, devices: DataFrame, order: Sequence[str] = ("page_start_tm", "page_id")
) -> DataFrame:
    """Latest profile of each device with its access count and device record."""
    profile = pages.groupBy("device_id").agg(
        *[_latest(c, order) for c in ("user_id", "app_ver", "device_model", "req_url")],
        F.max("page_start_tm").alias("last_page"),
    )
    visits = access.groupBy("device_id").agg(
        F.max("log_date").alias("last_access"), F.sum("visit_cnt").alias("access_count")
    )
    records = devices.select("device_id", "created_date", "active_st", "vip_yn")
    return profile.join(visits, "device_id", "left").join(records, "device_id", "left")


def log_context(
    events: DataFrame, anchors: DataFrame, before: int = 11, after: int = 10, range_ms: int | None = None,
    order: Sequence[str] = ("log_tm", "event_id"), width: int = SLICE,
) -> DataFrame:
    """Rows of the device around each anchor time: ``before`` up to and including it, ``after`` later.

    Rows and anchors get positions from one running count; an anchor then asks for its positions by an
    equi join. Nothing is compared pairwise, however many rows or anchors a device has.
    """
    columns = events.columns
    rows = events.withColumn("_anchor", F.lit(0)).withColumn("anchor_ms", F.lit(None).cast("long"))
    marks = anchors.select("device_id", F.col("anchor_ms").alias("log_tm"), F.lit(1).alias("_anchor"), "anchor_ms").distinct()
    both = rows.unionByName(marks, allowMissingColumns=True)
    placed = (
        SegmentedScan(both, ["device_id"], [order[0], "_anchor", *order[1:]], time_slice(order[0], width))
        .running_sum("_pos", F.when(F.col("_anchor") == 0, 1).otherwise(0))
        .done()
    )
    asked = placed.filter("_anchor = 1").select(
        "device_id", "anchor_ms", F.col("_pos").alias("_at"),
        F.explode(F.sequence(F.col("_pos") - (before - 1), F.col("_pos") + after)).alias("_pos"),
    )
    rows_at = placed.filter("_anchor = 0").drop("_anchor", "anchor_ms")
    found = asked.join(rows_at, ["device_id", "_pos"]).withColumn("offset", F.col("_pos") - F.col("_at"))
    if range_ms is not None:
        found = found.filter(F.abs(F.col("log_tm") - F.col("anchor_ms")) < range_ms)
    return found.select("anchor_ms", "offset", *columns)


def page_relations(
    pages: DataFrame, page: str | None = None, target: str | None = None, n: int = 10, url: str = "page_name", pre: str = "pre_page"
) -> DataFrame:
    """Where visitors of a page come from (IN) and go to (OUT): top n, the target, and the rest as Others.

    Without ``page`` the relations of every page are given.
    """
    moves = pages.filter(F.col(url) != F.col(pre))
    sides = F.array(
        F.struct(F.col(url).alias("page"), F.lit("IN").alias("direction"), F.col(pre).alias("other")),
        F.struct(F.col(pre).alias("page"), F.lit("OUT").alias("direction"), F.col(url).alias("other")),
    )
    both = moves.select(F.inline(sides)).filter("page != ''")
    if page is not None:
        both = both.filter(F.col("page") == page)
    counts = both.groupBy("page", "direction", "other").agg(count_rows())
    group = ["page", "direction"]
    # One row per neighbour of a page, not per visit.
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("cnt").desc(), "other"))
    # A target below the top is shown by itself and stays part of Others.
    extra = F.lit(False) if target is None else (F.col("direction") == "OUT") & (F.col("other") == target)
    shown = F.struct("other", F.lit(0).alias("is_other"), (F.col("_rank") > n).alias("_twice"))
    rest = F.struct(F.lit("Others").alias("other"), F.lit(1).alias("is_other"), F.lit(False).alias("_twice"))
    rows = counts.withColumn("_rank", rank).select(
        *group, "cnt",
        F.inline(F.when(F.col("_rank") <= n, F.array(shown)).when(extra, F.array(shown, rest)).otherwise(F.array(rest))),
    )
    listed = rows.groupBy(*group, "other", "is_other", "_twice").agg(F.sum("cnt").alias("cnt"))
    # At most n + 2 rows per page and direction from here on.
    total = F.sum(F.when(~F.col("_twice"), F.col("cnt"))).over(Window.partitionBy(*group))
    return listed.select(
        *group, F.when(F.col("other") == "", "-").otherwise(F.col("other")).alias("other"), "cnt", "is_other", total.alias("total")
    )


def lead_time() -> Column:
    """Time from the end of the page before, 0 when it is not known."""
    known = F.coalesce(F.col("pre_url_time"), F.lit(0)) != 0
    return F.when(known, F.col("page_start_tm") - F.col("pre_url_time")).otherwise(F.lit(0))


def reach_bounce(
    pages: DataFrame, pre: Sequence[str], target: str, start_ms: int, end_ms: int, grain: str = "hour", tz: str = "UTC",
    url: str = "page_name", pre_col: str = "pre_page",
) -> DataFrame:
    """Visitors coming from given pages: users, those who reach the target, those who go elsewhere, mean lead."""
    rows = between_ms(pages, "page_start_tm", start_ms, end_ms + 1).filter(F.col(pre_col).isin(*pre))
    bucket = tg.hour_of("page_start_tm", tz) if grain == "hour" else tg.day_of("page_start_tm", tz)
    aggs = [
        F.count_distinct("device_id").alias("users"),
        F.count_if(F.col(url) == target).alias("reach"),
        F.count_if(F.col(url) != target).alias("bounce"),
    ]
    if grain == "day":
        aggs.append(F.round(F.avg(lead_time()), 6).alias("lead"))
    return rows.groupBy(bucket.alias("bucket"), "package_nm", "server_type").agg(*aggs)


def reach_bounce_rate(df: DataFrame) -> DataFrame:
    """Reach and bounce as percent with one decimal."""
    total = F.col("reach") + F.col("bounce")
    return df.select(
        "*",
        *[(F.floor(F.col(c) / total * 1000 + 0.5) / 10).alias(f"{c}_rate") for c in ("reach", "bounce")],
    )


def interpolate_hours(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("package_nm", "server_type"), bucket: str = "bucket"
) -> DataFrame:
    """Hours missing between known ones, filled on a straight line and rounded.

    A group has at most one row per hour, which bounds the window.
    """
    by = list(by)
    bounds = df.groupBy(*by).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi"))
    grid = bounds.select(*by, F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 HOUR"))).alias(bucket))
    rows = grid.join(df.select(*by, bucket, *cols), [*by, bucket], "left")
    rows = rows.withColumn("_known", F.when(F.col(cols[0]).isNotNull(), F.col(bucket).cast("long")))
    order = Window.partitionBy(*by).orderBy(bucket)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)

    def before(c):
        return F.last(c, ignorenulls=True).over(back)

    def later(c):
        return F.first(c, ignorenulls=True).over(ahead)

    span = later("_known") - before("_known")
    ratio = (F.col(bucket).cast("long") - before("_known")) / F.when(span > 0, span)
    line = {c: F.floor(before(c) + (later(c) - before(c)) * ratio + 0.5).cast("long") for c in cols}
    return rows.select(*by, bucket, *[F.coalesce(F.col(c).cast("long"), v).alias(c) for c, v in line.items()])


def reach_bounce_rows(
    pages: DataFrame, pre: Sequence[str], target: str, outcome: str, size: int = 50, after: Sequence[object] | None = None,
    url: str = "page_name", pre_col: str = "pre_page",
) -> DataFrame:
    """Newest rows of one outcome with lead, and the total and mean lead of all rows on each."""
    hit = F.col(url) == target
    rows = pages.filter(F.col(pre_col).isin(*pre)).filter(hit if outcome == "reach" else ~hit)
    rows = rows.withColumn("_lead", lead_time())
    shown = keyset_page(rows, [("page_start_tm", True), ("device_id", True)], size, after)
    known = F.coalesce(F.col("pre_url_time"), F.lit(0)) != 0
    shown = shown.withColumn("lead", F.when(known, F.col("_lead").cast("string")).otherwise("-")).drop("_lead")
    return with_overall(shown, rows, {"total": F.count(F.lit(1)), "lead_avg": F.round(F.avg("_lead"), 6)})


def flow_summary(pages: DataFrame, width: int = SLICE, order: Sequence[str] = ("page_start_tm", "page_id"), url: str = "page_name") -> DataFrame:
    """By step, page and next page of the session: requests, trouble, stay, averages and figures of end nodes.

    The stored query of this report is not known; the columns follow what its reader expects. Pages that
    already carry ``next_url`` are not ordered again.
    """
    if "next_url" in pages.columns:
        nexts = pages.withColumn("next_page", F.substring_index("next_url", "?", 1))
    else:
        session = ["device_id", "parent_log_date"]
        nexts = SegmentedScan(pages, session, order, time_slice("page_start_tm", width)).lead("next_page", url).done()
    end = F.col("next_page").isNull()
    stay = F.col("intervaltime")

    def at_end(agg, name):
        return agg.alias(f"node_end_{name}")

    return nexts.groupBy("package_nm", "flow_order", F.col(url).alias("page"), "next_page").agg(
        count_rows("req_count"), *sums("crash_count", "error_count"),
        F.sum(stay).alias("sum_intervaltime"), F.min(stay).alias("min_intervaltime"), F.max(stay).alias("max_intervaltime"),
        at_end(F.count_if(end), "req_count"),
        at_end(F.coalesce(F.sum(F.when(end, F.col("crash_count"))), F.lit(0)), "crash_count"),
        at_end(F.coalesce(F.sum(F.when(end, F.col("error_count"))), F.lit(0)), "error_count"),
        at_end(F.sum(F.when(end, stay)), "sum_intervaltime"),
        at_end(F.min(F.when(end, stay)), "min_intervaltime"),
        at_end(F.max(F.when(end, stay)), "max_intervaltime"),
        mean("response_time", "avg_response_time"), mean("loading_time", "avg_loading_time"),
        mean("sum_cpu_usage", "avg_cpu_usage"), mean("sum_mem_usage", "avg_mem_usage"),
    )


def session_bounds(pages: DataFrame, session_log: DataFrame, app_start: int = lt.APP_START) -> DataFrame:
    """Start is the app-start page's time, else the first log; end is the last log."""
    starts = pages.filter(F.col("log_type") == app_start).groupBy("session_id").agg(F.min("page_start_tm").alias("_start"))
    logs = session_log.groupBy("session_id").agg(F.min("log_tm").alias("_first"), F.max("log_tm").alias("end_tm"))
    return logs.join(starts, "session_id", "left").select(
        "session_id", F.coalesce("_start", "_first").alias("start_tm"), "end_tm"
    )


def replay_actions(session_log: DataFrame, pages: DataFrame) -> DataFrame:
    """Actions of a replay, with the loading time on page starts, found by (time, device)."""
    actions = session_log.filter(F.col("log_type").isin(*lt.REPLAY))
    loads = pages.groupBy("device_id", F.col("page_start_tm").alias("log_tm")).agg(F.max("loading_time").alias("_load"))
    joined = actions.join(loads, ["device_id", "log_tm"], "left")
    is_page = F.col("log_type").isin(*lt.WEB_PAGE)
    return joined.withColumn("loading_time", F.when(is_page, F.col("_load"))).drop("_load")


def session_detail(pages: DataFrame, vitals: DataFrame, events: DataFrame, n: int) -> dict[str, DataFrame]:
    """Profile, vitals, last pages and last replay events of each device since its latest session began."""
    order = ["page_start_tm", "page_id"]
    profile = pages.groupBy("device_id").agg(
        F.max("parent_log_date").alias("session_start"),
        *[_latest(c, order) for c in ("user_id", "os_type", "app_ver", "device_model")],
    )
    since = profile.select("device_id", "session_start")
    current = vitals.join(since, "device_id").filter("log_tm >= session_start")
    means = current.groupBy("device_id").agg(
        *[F.round(F.avg(F.when(F.col("name") == v, F.col("value"))), 8).alias(v) for v in ("lcp", "inp", "cls")]
    )
    page_rows = pages.join(since, "device_id").filter("page_start_tm >= session_start")
    replay = events.filter(F.col("log_type").isin(*lt.REPLAY)).join(since, "device_id").filter("log_tm >= session_start")
    return {
        "profile": profile,
        "vitals": means,
        "pages": top_n(page_rows, ["device_id"], [F.col("page_start_tm").desc(), F.col("page_id").desc()], n),
        "events": top_n(replay, ["device_id"], [F.col("log_tm").desc(), F.col("event_id").desc()], n),
    }


def page_events(events: DataFrame, views: DataFrame) -> DataFrame:
    """All events of the given page views."""
    wanted = views.select(F.col("page_id")).distinct()
    return events.join(wanted, "page_id", "left_semi")


