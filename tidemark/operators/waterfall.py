"""Page-load waterfalls from browser timing entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text

# Names of the short keys of timing entries (fixed values).
PERF_KEYS = {
    "1": "name", "2": "entryType", "3": "startTime", "4": "duration", "5": "initiatorType", "6": "deliveryType",
    "7": "nextHopProtocol", "8": "renderBlockingStatus", "9": "workerStart", "10": "redirectStart", "11": "redirectEnd",
    "12": "fetchStart", "13": "domainLookupStart", "14": "domainLookupEnd", "15": "connectStart",
    "16": "secureConnectionStart", "17": "connectEnd", "18": "requestStart", "19": "responseStart",
    "20": "firstInterimResponseStart", "21": "finalResponseHeadersStart", "22": "responseEnd", "23": "transferSize",
    "24": "encodedBodySize", "25": "decodedBodySize", "26": "responseStatus", "27": "serverTiming", "28": "attribution",
    "29": "renderStart", "30": "styleAndLayoutStart", "31": "firstUIEventTimestamp", "32": "blockingDuration",
    "33": "scripts", "35": "renderTime", "36": "loadTime", "40": "hadRecentInput", "41": "lastInputTime", "42": "sources",
    "43": "unloadEventStart", "44": "unloadEventEnd", "45": "domInteractive", "46": "domContentLoadedEventStart",
    "47": "domContentLoadedEventEnd", "48": "domComplete", "49": "loadEventStart", "50": "loadEventEnd",
    "52": "redirectCount", "53": "activationStart", "54": "criticalCHRestart", "55": "notRestoredReasons",
    "56": "interactionId", "57": "processingStart", "58": "processingEnd", "59": "cancelable",
}
# Keys whose values are objects or arrays with short keys of their own.
NESTED = ("serverTiming", "attribution", "scripts", "sources", "notRestoredReasons")

VIEW = ["device_id", "page_id"]


def _with_body(df: DataFrame, col: str) -> DataFrame:
    """Entry text as a JSON object: escaped commas undone, and a JSON string around the object."""
    plain = F.replace(F.replace(F.col(col), F.lit("^"), F.lit(",")), F.lit("|"), F.lit("\n"))
    raw = df.filter(F.col(col).rlike(r'^\s*["{]')).withColumn(col, F.trim(plain))
    inner = F.get(F.from_json(F.concat(F.lit("["), F.col(col), F.lit("]")), "array<string>"), F.lit(0))
    return raw.withColumn(col, F.when(F.col(col).startswith('"'), inner).otherwise(F.col(col)))


def expand_perf_keys(df: DataFrame, col: str = "entry", keys: dict[str, str] | None = None) -> DataFrame:
    """JSON text with short keys to a map with full names, nested objects included."""
    keys = keys or PERF_KEYS
    names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    quoted = F.array(*[F.struct(F.lit(f'"{k}":').alias("s"), F.lit(f'"{n}":').alias("f")) for k, n in keys.items()])

    def full(value: Column) -> Column:
        return F.aggregate(quoted, value, lambda text, pair: F.replace(text, pair["s"], pair["f"]))

    parsed = _with_body(df, col).withColumn(col, F.from_json(col, "map<string,string>")).filter(F.col(col).isNotNull())
    named = F.transform_keys(F.col(col), lambda k, _: F.coalesce(F.element_at(names, k), k))
    return parsed.withColumn(col, F.transform_values(named, lambda k, v: F.when(k.isin(*NESTED), full(v)).otherwise(v)))


# Fields the waterfall reads, besides ``url`` and ``size``, which have no short key.
_USED = (
    "name", "entryType", "startTime", "duration", "initiatorType", "redirectStart", "redirectEnd", "fetchStart",
    "domainLookupStart", "domainLookupEnd", "connectStart", "secureConnectionStart", "connectEnd", "requestStart",
    "responseStart", "responseEnd", "transferSize", "responseStatus", "domInteractive", "domContentLoadedEventEnd",
    "domComplete", "loadEventEnd",
)
_BROKEN = "_broken"


def read_entries(df: DataFrame, col: str = "entry") -> DataFrame:
    """Parse timing entries against a declared schema, so only the fields a step reads are extracted.

    Text that does not parse is no entry and is dropped, as in ``expand_perf_keys``.
    """
    short = {name: key for key, name in PERF_KEYS.items()}
    fields = {**{short[name]: name for name in _USED}, "url": "url", "size": "size"}
    schema = T.StructType([T.StructField(key, T.StringType()) for key in (*fields, _BROKEN)])
    read = F.from_json(col, schema, {"columnNameOfCorruptRecord": _BROKEN})
    # Exploding the one whole entry, or none, parses a text once; a filter on the parsed column would parse it again.
    whole = F.explode_outer(F.filter(F.array(read), lambda e: e[_BROKEN].isNull()))
    kept = [c for c in df.columns if c != col]
    parsed = _with_body(df, col).select(*kept, whole.alias("_e")).filter(F.col("_e").isNotNull())
    entry = F.struct(*[F.col("_e")[key].alias(name) for key, name in fields.items()])
    rows = parsed.select(*kept, entry.alias("entry"))
    return rows.withColumns(
        {"entry_type": _text("entryType"), "name": _text("name"), "start_time": _number("startTime"), "duration": _number("duration")}
    )


def _number(name: str) -> Column:
    value = F.col("entry")[name].try_cast("double")
    return F.when(F.isnan(value), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def _text(name: str) -> Column:
    return F.coalesce(F.col("entry")[name], F.lit(""))


# Phases of a navigation: label, start field, end field (fixed values).
PHASES = (
    ("Waiting", "startTime", "requestStart"),
    ("DNS Lookup", "domainLookupStart", "domainLookupEnd"),
    ("TCP Connect Start", "connectStart", "connectEnd"),
    ("Request Time", "requestStart", "responseStart"),
    ("Response Time", "responseStart", "responseEnd"),
    ("Dom Processing", "responseEnd", "domContentLoadedEventEnd"),
    ("Dom Load", "domContentLoadedEventEnd", "loadEventEnd"),
)


def _phases() -> Column:
    """The navigation's phases, in order, that have a start above 0 and an end not before it."""
    steps = F.array(*[
        F.struct(F.lit(i).alias("phase_no"), F.lit(n).alias("name"), _number(a).alias("start_time"), _number(b).alias("response_end"))
        for i, (n, a, b) in enumerate(PHASES)
    ])
    return F.filter(steps, lambda p: (p["response_end"] >= p["start_time"]) & (p["start_time"] > 0))


def first_navigation(entries: DataFrame) -> DataFrame:
    """The first navigation entry of each page view."""
    navs = entries.filter(F.col("entry_type") == "navigation")
    return navs.groupBy(*VIEW).agg(F.min_by("entry", "seq").alias("entry"))


def nav_phases(entries: DataFrame) -> DataFrame:
    """Seven phases of each navigation; a phase needs a start above 0 and an end not before it."""
    phases = first_navigation(entries).select(
        *VIEW, _text("name").alias("url"), _number("transferSize").cast("long").alias("transfer_size"),
        _number("responseStatus").cast("long").alias("status"), F.inline(_phases()),
    )
    return phases.withColumn("duration", F.col("response_end") - F.col("start_time"))


def _paint() -> Column:
    """Size, order and URL of an entry that is a paint with a URL and a size; of several the greatest is the largest, the first of equals."""
    size = _number("size").cast("long")
    is_paint = (F.col("entry_type") == "largest-contentful-paint") & (_text("url") != "") & (size > 0)
    return F.when(is_paint, F.struct(size.alias("size"), (-F.col("seq")).alias("before"), _text("url").alias("url")))


def mark_lcp(entries: DataFrame) -> DataFrame:
    """Largest paint of each page view: its URL, size, and the first entry with that URL as name.

    Paints and the entries they name meet in a window over one shuffle by view. No join is left to the planner, which cannot know how many
    entries a text unfolds to and so may send all of them to every task. A view without a device or page id is none.
    """
    own = entries.filter((F.col("entry_type") != "navigation") & F.col(VIEW[0]).isNotNull() & F.col(VIEW[1]).isNotNull())
    moved = own.select(*VIEW, "seq", "name", _paint().alias("_paint"))
    known = moved.withColumn("_largest", F.max("_paint").over(Window.partitionBy(*VIEW)))
    named = known.filter(F.col("name") == F.col("_largest.url"))
    return named.groupBy(*VIEW, F.col("_largest.url").alias("lcp_url"), F.col("_largest.size").alias("lcp_size")).agg(F.min("seq").alias("seq"))


def waterfall_rows(entries: DataFrame) -> DataFrame:
    """Rows of the waterfall: navigation phases first, then the other entries by start.

    A page view has few entries, so all that is asked of a view (its first navigation, its largest paint, the first entry
    of that name, the position) is a window over one shuffle by view. Navigations are unfolded before it and all windows ask for the
    order of the rows shown, so a view's rows are sorted once. What follows from other columns is worked out after the sort.
    """
    kind, initiator, is_nav = F.col("entry_type"), F.lower(_text("initiatorType")), F.col("entry_type") == "navigation"
    phases = F.transform(_phases(), lambda p: F.struct(
        F.lit(0).alias("_other"), p["phase_no"].alias("seq"), p["name"].alias("name"), F.lit(None).cast("string").alias("_url"),
        F.lit("reformNavigation").alias("entry_type"), F.lit(None).cast("string").alias("_initiator"),
        p["start_time"].alias("start_time"), (p["response_end"] - p["start_time"]).alias("duration"),
    ))
    single = F.array(F.struct(
        F.lit(1).alias("_other"), F.col("seq"), F.col("name"), F.nullif(_text("url"), F.lit("")).alias("_url"), F.col("entry_type"),
        F.when(kind == "resource", F.nullif(initiator, F.lit(""))).alias("_initiator"), F.col("start_time"), F.col("duration"),
    ))
    # A navigation without phases leaves a row without ``_other``, so that a later navigation does not count as the first.
    moved = entries.select(
        *VIEW, F.when(is_nav, F.col("seq")).alias("_nav"), _paint().alias("_paint"), _number("transferSize").cast("long").alias("transfer_size"),
        _number("responseStatus").cast("long").alias("status"), F.inline_outer(F.when(is_nav, phases).otherwise(single)),
    )
    view = Window.partitionBy(*VIEW).orderBy("_other", "start_time", "seq")
    whole = view.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = moved.withColumns({"_first": F.min("_nav").over(whole), "_largest": F.max("_paint").over(whole)["url"]})
    named = (F.col("_other") == 1) & (F.col("name") == F.col("_largest"))
    marked = known.withColumn("_marked", F.min(F.when(named, F.col("seq"))).over(whole))
    rows = marked.filter((F.col("_other") == 1) | ((F.col("_other") == 0) & (F.col("_nav") == F.col("_first"))))
    placed = rows.withColumn("position", F.row_number().over(view)).withColumns({
        "name": F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("_url"), F.col("entry_type")),
        "kind": F.coalesce("_initiator", F.nullif(F.lower("entry_type"), F.lit("")), F.lit("other")),
        "mark": F.when((F.col("_other") == 1) & (F.col("seq") == F.col("_marked")), "lcp"),
    })
    end = F.col("start_time") + F.greatest(F.col("duration"), F.lit(0.0))
    return placed.select(
        *VIEW, F.col("position").cast("long").alias("position"), "name", "entry_type", "kind",
        F.coalesce(F.regexp_extract("name", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit("")).alias("domain"),
        "start_time", "duration", "status", text.fmt_bytes("transfer_size").alias("size_label"),
        F.format_string("%.1fms ~ %.1fms", F.bround("start_time", 1), F.bround(end, 1)).alias("time_label"), "mark",
    )


def timing_summary(entries: DataFrame, vitals: DataFrame | None = None) -> DataFrame:
    """Timings of each page view; a time or vital of 0 means it is not known."""
    kind = F.col("entry_type")

    def nav(expr: Column) -> Column:
        return F.max_by(F.when(kind == "navigation", expr), F.when(kind == "navigation", F.col("seq")))

    def known(expr: Column) -> Column:
        return F.when(F.abs(expr) >= 1e-9, expr)

    def span(a: str, b: str) -> Column:
        return known(nav(_number(b) - _number(a)))

    secure = F.when(_number("secureConnectionStart") > 0, _number("connectEnd") - _number("secureConnectionStart")).otherwise(0.0)
    input_at = (kind == "first-input") & (F.col("start_time") != 0)
    rows = entries.groupBy(*VIEW).agg(
        F.max_by("start_time", F.when(input_at, F.col("seq"))).alias("fid"),
        known(F.sum(F.when(kind == "longtask", F.col("duration") - 50.0))).alias("tbt"),
        span("startTime", "domContentLoadedEventEnd").alias("dcl_time"),
        span("startTime", "loadEventEnd").alias("load_time"),
        span("domInteractive", "domComplete").alias("dom_processing_time"),
        known(nav(_number("connectEnd") - _number("connectStart") + secure)).alias("connection_time"),
        span("domainLookupStart", "domainLookupEnd").alias("dns_lookup_time"),
        span("redirectStart", "redirectEnd").alias("redirect_time"),
        span("fetchStart", "responseEnd").alias("fetch_time"),
        known(nav(_number("domInteractive"))).alias("dom_interactive"),
    )
    if vitals is None:
        return rows
    latest = vitals.groupBy(*VIEW).agg(
        *[F.max_by("value", F.when((F.lower(F.trim("name")) == n) & (F.col("value") != 0) & ~F.isnan("value"), F.col("log_tm"))).alias(n) for n in ("fcp", "lcp", "inp", "cls", "ttfb")]
    )
    return rows.join(latest, VIEW, "left")


LANES = {"event": "click", "longtask": "long_task", "resource": "resource"}


def perf_lanes(entries: DataFrame, errors: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Click, long-task and resource spans of each page view, with its errors placed by time since the page start."""
    lane = F.lit(None).cast("string")
    for kind, name in LANES.items():
        lane = F.when(F.col("entry_type") == kind, F.lit(name)).otherwise(lane)
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("entry_type"))
    spans = entries.withColumn("lane", lane).filter("lane IS NOT NULL").select(*VIEW, "lane", label.alias("label"), F.col("start_time").alias("start"), "duration")
    if errors is None or starts is None:
        return spans
    placed = errors.join(starts.select(*VIEW, F.col("page_start_tm").alias("_from")), VIEW).select(
        *VIEW, F.lit("error").alias("lane"), F.col("log_name").alias("label"),
        (F.col("log_tm") - F.col("_from")).cast("double").alias("start"), F.lit(0.0).alias("duration"),
    )
    return spans.unionByName(placed)


