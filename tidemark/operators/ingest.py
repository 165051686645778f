"""From decoded lines to clean tables: routing, dedup, identity, traffic, errors, URL keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import logtypes as lt
from tidemark.functions import text


def tag_clock_skew(df: DataFrame, arrival: str = "timestamp", ts_ms: str = "log_tm", tol_s: int = 180) -> DataFrame:
    """``anomaly`` is ``nn`` for rows whose clock is more than ``tol_s`` ahead of their arrival, else ``n``."""
    ahead = F.unix_timestamp(F.timestamp_millis(F.col(ts_ms))) - F.unix_timestamp(arrival)
    return df.withColumn("anomaly", F.when(ahead <= tol_s, "n").otherwise("nn"))


def filter_clock_skew(
    df: DataFrame,
    now: Column | None = None,
    ts_ms: str = "log_tm",
    tol_s: int = 180,
    required: Sequence[str] = ("server_type", "package_nm", "log_date"),
) -> DataFrame:
    """Drop rows from the future and rows without server, package or day."""
    limit = F.unix_millis(now if now is not None else F.current_timestamp()) + tol_s * 1000
    keep = F.col(ts_ms) < limit
    for name in required:
        keep = keep & F.col(name).isNotNull()
    return df.filter(keep)


def route_by_type(df: DataFrame, sets: Mapping[str, Sequence[int]] | None = None) -> dict[str, DataFrame]:
    """Sub-streams by log-type set; by default waterfall rows and the rest."""
    if sets is not None:
        return {name: df.filter(F.col("log_type").isin(*types)) for name, types in sets.items()}
    waterfall = F.coalesce(F.col("log_type").isin(*lt.WATERFALL), F.lit(False))
    return {"waterfall": df.filter(waterfall), "events": df.filter(~waterfall)}


STREAMS = {
    "vital": lt.VITAL,
    "network": lt.NETWORK,
    "network_error": lt.NETWORK_ERROR,
    "error": lt.ERROR,
    "crash": (lt.CRASH,),
    "access": lt.ACCESS,
    "visit": lt.VISIT,
    "page": lt.WEB_PAGE,
    "webperf": lt.WEBPERF,
    "native": lt.NATIVE,
}


def tag_streams(df: DataFrame) -> DataFrame:
    """One flag column per sub-stream, for writing all branches from a single pass."""
    flags = [F.coalesce(F.col("log_type").isin(*types), F.lit(False)).alias(f"is_{name}") for name, types in STREAMS.items()]
    return df.select("*", *flags)


def derive_trouble(events: DataFrame, types: Sequence[int] = lt.TROUBLE) -> DataFrame:
    """Error and crash rows with ``log_name``, the first line of the message."""
    return events.filter(F.col("log_type").isin(*types)).withColumn("log_name", text.first_line("res_msg"))


def url_sub_key(
    df: DataFrame,
    col: str,
    rewrites: Sequence[tuple[str, str]] = (),
    keep_params: Mapping[str, Sequence[str]] | None = None,
    name: str = "url_sub_key",
) -> DataFrame:
    """Page key from a URL: the first rewrite whose pattern starts the path, plus the listed parameters.

    Rules are configuration, so they become one column expression and need no join.
    """
    path = text.url_path(col)
    key = path
    for pattern, replacement in reversed(list(rewrites)):
        key = F.when(path.rlike(rf"\A(?:{pattern})"), F.lit(replacement)).otherwise(key)
    params = F.split(text.url_query(col), "&")
    result = F.col("_key")
    for owner, names in (keep_params or {}).items():
        rebuilt = F.concat(F.col("_key"), F.lit("?"), F.array_join(_kept_params(params, names), "&"))
        hit = (F.col("_key") == owner) & F.col(col).contains("?")
        result = F.when(hit, rebuilt).otherwise(result)
    keyed = df.withColumn("_key", F.coalesce(key, F.lit(""))).withColumn(name, result)
    return keyed.drop("_key")


def _kept_params(params: Column, names: Sequence[str]) -> Column:
    """``name=value`` of the listed parameters, in the order of the URL."""

    def part(param: Column, n: int) -> Column:
        return F.split_part(param, F.lit("="), F.lit(n))

    wanted = F.filter(params, lambda p: part(p, 1).isin(*names))
    return F.transform(wanted, lambda p: F.concat(part(p, 1), F.lit("="), part(p, 2)))


def dedup_latest(df: DataFrame, keys: Sequence[str], version: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per replacing key, the newest version wins.

    An aggregate, not a window: each task reduces its rows before the shuffle, so a key with very many
    versions is never sorted in one task. ``tiebreak`` decides between equal versions.
    """
    values = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(version).alias("v"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)])
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_identity(identity: DataFrame) -> DataFrame:
    """Newest non-blank user of each device."""
    known = identity.filter(F.trim("user_id") != "")
    return known.groupBy("device_id").agg(
        F.max_by("user_id", F.struct("updated_at", "user_id")).alias("mapped_user")
    )


def stitch_identity(events: DataFrame, identity: DataFrame, own_first: bool = False) -> DataFrame:
    """``user_key``: the mapped user of the device, else the device.

    The row's own user_id is used only for rows without a device, or before the device when
    ``own_first``. The identity table grows with devices, so the join is left to Spark: a broadcast only
    under its size threshold, otherwise a shuffle with skewed devices split.
    """
    mapped = events.join(latest_identity(identity), "device_id", "left")
    own = F.nullif(F.col("user_id"), F.lit(""))
    order = [F.col("mapped_user"), own, F.col("device_id")] if own_first else [F.col("mapped_user"), F.col("device_id"), own]
    return mapped.withColumn("user_key", F.coalesce(*order)).drop("mapped_user")


def backfill_identity(events: DataFrame, identity: DataFrame) -> DataFrame:
    """Rewrite ``user_key`` on a device's earlier events once its user is known."""
    mapped = events.join(latest_identity(identity), "device_id", "left")
    return mapped.withColumn("user_key", F.coalesce("mapped_user", "user_key")).drop("mapped_user")


# Search engines by referrer domain (fixed values).
SEARCH_ENGINES = {
    "google.com": "google", "google.co.kr": "google", "google.co.jp": "google", "naver.com": "naver",
    "m.naver.com": "naver", "search.naver.com": "naver", "daum.net": "daum", "search.daum.net": "daum",
    "bing.com": "bing", "yahoo.com": "yahoo", "duckduckgo.com": "duckduckgo", "baidu.com": "baidu",
    "yandex.ru": "yandex", "ecosia.org": "ecosia", "search.brave.com": "brave",
}


def attribute_traffic(events: DataFrame, engines: DataFrame) -> DataFrame:
    """Traffic source and medium. Web rows fall back to the engine, the referrer, then direct."""
    known = engines.groupBy("domain").agg(F.max("engine_name").alias("_engine"))
    joined = events.join(known, events["referrer_domain"] == known["domain"], "left").drop("domain")
    web = F.lower("platform") == "web"

    def given(col: str) -> Column:
        return F.nullif(F.col(col), F.lit(""))

    referrer = given("referrer_domain")
    source = F.when(web, F.coalesce(given("source"), F.col("_engine"), referrer, F.lit("direct"))).otherwise(given("source"))
    by_referrer = F.when(F.col("_engine").isNotNull(), "organic").when(referrer.isNotNull(), "referral").otherwise("none")
    medium = F.when(web, F.coalesce(given("explicit_medium"), by_referrer)).otherwise(given("explicit_medium"))
    return joined.withColumn("traffic_source", source).withColumn("medium", medium).drop("_engine")
