"""Scalar functions: masking, units, hashes, network codes, URL parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def mask_user(user: Column | str, keep: int) -> Column:
    """Keep the first characters and star the rest; blank becomes ``-``."""
    user = _col(user)
    count = F.greatest(F.length(user) - keep, F.lit(0))
    blank = user.isNull() | (F.trim(user) == "")
    return F.when(blank, F.lit("-")).otherwise(F.concat(F.substring(user, 1, keep), F.repeat(F.lit("*"), count)))


def mask_range(text: Column | str, start: int, end: int) -> Column:
    """Star the characters from ``start`` up to ``end``; shorter text stays as it is."""
    text = _col(text)
    if start >= end:
        return text
    masked = F.concat(F.substring(text, 1, start), F.lit("*" * (end - start)), F.substring(text, end + 1, 1 << 30))
    return F.when(F.length(text) < end, text).otherwise(masked)


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)


def fmt_mem(value: Column | str, unit: str) -> Column:
    """KB as MB, MB as GB, one decimal; an unknown unit or text that is no number gives ``0GB``, no value or 0 ``0MB``."""
    given = F.nullif(F.trim(_col(value).cast("string")), F.lit(""))
    value = given.try_cast("double")
    label = {"kb": "MB", "mb": "GB"}.get(unit.lower())
    shown = F.lit("0GB") if label is None else F.concat(_one_decimal(value / 1024), F.lit(label))
    return F.when(given.isNull() | (value == 0) | F.isnan(value), F.lit("0MB")).when(value.isNull(), F.lit("0GB")).otherwise(shown)


def fmt_bytes(size: Column | str) -> Column:
    """Bytes as B, KB, MB or GB, one decimal from KB on; ``0`` when there is no size."""
    size = _col(size).cast("double")
    return (
        F.when(size.isNull(), F.lit("0"))
        .when(F.abs(size) < 1024, F.concat(F.bround(size).cast("long").cast("string"), F.lit(" B")))
        .when(F.abs(size) < 1024**2, F.concat(_one_decimal(F.bround(size / 1024, 1)), F.lit(" KB")))
        .when(F.abs(size) < 1024**3, F.concat(_one_decimal(F.bround(size / 1024**2, 1)), F.lit(" MB")))
        .otherwise(F.concat(_one_decimal(F.bround(size / 1024**3, 1)), F.lit(" GB")))
    )


def fmt_ms(ms: Column | str, decimals: bool = False, detail: bool = True) -> Column:
    """Milliseconds as ``ms``, ``s``, ``m`` (with seconds in detail) or ``h`` text."""
    ms = _col(ms).cast("long")
    seconds = F.floor(ms / 1000)
    exact = F.regexp_replace(F.format_string("%.2f", ms / F.lit(1000.0)), r"\.?0+$", "")
    minutes = F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"))
    rest = F.concat(F.lit(" "), F.floor(F.pmod(ms, F.lit(60_000)) / 1000).cast("string"), F.lit("s"))
    return (
        F.when(ms.isNull() | (ms < 0), F.lit("0ms"))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(exact if decimals else seconds.cast("string"), F.lit("s")))
        .when(ms < 3_600_000, F.concat(minutes, rest) if detail else minutes)
        .otherwise(F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit("h")))
    )


def hash_key(value: Column | str, kind: str = "64") -> Column:
    """Hex hash of a key, NULL for blank text.

    ``32`` is CRC-32. ``64`` is xxHash64, a different function from CRC-64 or murmur with the same use.
    """
    value = _col(value)
    text = F.crc32(value.cast("binary")) if kind == "32" else F.xxhash64(value)
    width = "%08x" if kind == "32" else "%016x"
    return F.when(F.trim(value) != "", F.format_string(width, text))


# Network names by code and alias (fixed values).
NETWORK_NAMES = {"1": "WiFi", "2": "2G", "3": "3G", "4": "LTE", "5": "5G"}
NETWORK_ALIASES = {"wifi": "WiFi", "2g": "2G", "3g": "3G", "4g": "LTE", "lte": "LTE", "5g": "5G"}


def normalise_network(code: Column | str) -> Column:
    """Numeric or text network type to its display name, ``ETC`` when unknown."""
    text = F.lower(F.trim(_col(code).cast("string")))
    found = F.lit("ETC")
    for key, name in (NETWORK_NAMES | NETWORK_ALIASES).items():
        found = F.when(text == key, F.lit(name)).otherwise(found)
    return found


def url_path(url: Column | str) -> Column:
    """The part before the first ``?``."""
    return F.substring_index(_col(url), "?", 1)


def url_query(url: Column | str) -> Column:
    """The text between the first and second ``?``, empty when there is none."""
    return F.split_part(_col(url), F.lit("?"), F.lit(2))


def first_line(message: Column | str) -> Column:
    """First line of a message, NULL when empty."""
    lines = F.replace(F.coalesce(_col(message), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.nullif(F.substring_index(lines, "\n", 1), F.lit(""))


def speed_class(time: Column | str, standard: Column | str) -> Column:
    """0 to 4 by time against 0.6, 0.8, 1.0 and 1.2 of the standard; 4 when there is none."""
    time, standard = _col(time), _col(standard)
    return (
        F.when(standard.isNull() | time.isNull(), 4)
        .when(time <= standard * 0.6, 0)
        .when(time <= standard * 0.8, 1)
        .when(time <= standard * 1.0, 2)
        .when(time <= standard * 1.2, 3)
        .otherwise(4)
    )
