"""Location names, stack frames and their positions in the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.segmented import SegmentedScan

# A frame line: ``at name (file:line:column)``, ``name (file:line:column)`` or ``at file:line:column``.
FRAME = r"(?:\(|\bat\s+)((?:https?://)?[^\s()<>]+?):(\d+)(?::(\d+))?\)?\s*$"


# Province codes with their Korean, English and Japanese names (fixed values).
LOCATIONS = {
    "kr-4194": ("-", "-", "-"),
    "kr-kg": ("경기도", "Gyeonggi-do", "キョンギド"),
    "kr-cb": ("전라북도", "North Jeolla", "チョルラブクド"),
    "kr-kn": ("경상남도", "South Gyeongsang", "キョンサンナムド"),
    "kr-2685": ("전라남도", "South Jeolla", "チョルラナムド"),
    "kr-pu": ("부산광역시", "Busan Metropolitan City", "プサン広域市"),
    "kr-2688": ("경상북도", "North Gyeongsang", "キョンサンプクト"),
    "kr-sj": ("세종특별자치시", "Sejong Special Self-Governing City", "セジョン特別自治市"),
    "kr-tj": ("대전광역시", "Daejeon Metropolitan City", "テジョン広域市"),
    "kr-ul": ("울산광역시", "Ulsan Metropolitan City", "ウルサン広域市"),
    "kr-in": ("인천광역시", "Incheon Metropolitan City", "インチョン広域市"),
    "kr-kw": ("강원특별자치도", "Gangwon Special Self-Governing Province", "カンウォン特別自治道"),
    "kr-gn": ("충청남도", "South Chungcheong", "チュンチョンナムド"),
    "kr-cj": ("제주특별자치도", "Jeju Special Self-Governing Province", "チェジュ特別自治道"),
    "kr-gb": ("충청북도", "North Chungcheong", "チュンチョンプクト"),
    "kr-so": ("서울특별시", "Seoul Special City", "ソウル特別市"),
    "kr-tg": ("대구광역시", "Daegu Metropolitan City", "テグ広域市"),
    "kr-kj": ("광주광역시", "Gwangju Metropolitan City", "クァンジュ広域市"),
}
LANGUAGES = ("ko", "en", "ja")


def _lookup(value: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Value of a small fixed table, the text itself where it is not listed."""
    col = F.col(value) if isinstance(value, str) else value
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.coalesce(F.try_element_at(table, F.trim(col)), col)


def location_name(code: Column | str, lang: str = "ko") -> Column:
    """Province code to its name; other codes stay as they are."""
    i = LANGUAGES.index(lang)
    return _lookup(code, [(c, names[i]) for c, names in LOCATIONS.items()])


def location_code(name: Column | str, lang: str = "ko") -> Column:
    """Province name back to its code; other names stay as they are."""
    i = LANGUAGES.index(lang)
    return _lookup(name, [(names[i], c) for c, names in LOCATIONS.items()])


def stack_frames(trouble: DataFrame, col: str = "res_msg") -> DataFrame:
    """One row per stack frame: its place in the trace, file, line and column (1 when missing)."""
    lines = trouble.select("*", F.posexplode(F.split(F.col(col), r"\r\n|\n|\r")).alias("_line_no", "_line"))
    found = lines.withColumn("file", F.regexp_extract("_line", FRAME, 1)).filter("file != ''")
    column = F.regexp_extract("_line", FRAME, 3)
    return found.select(
        *[c for c in trouble.columns if c != col],
        F.col("_line_no").cast("long").alias("line_no"), "file",
        F.regexp_extract("_line", FRAME, 2).cast("long").alias("line"),
        F.when(column == "", 1).otherwise(column.try_cast("bigint")).cast("long").alias("column"),
    )


def crash_groups(frames: DataFrame, key: str = "event_id") -> DataFrame:
    """Crashes grouped by their top frame."""
    tops = frames.groupBy(key, "device_id").agg(F.min_by(F.struct("file", "line", "column"), "line_no").alias("top"))
    return tops.groupBy("top.file", "top.line", "top.column").agg(
        F.count(F.lit(1)).alias("cnt"), F.count_distinct("device_id").alias("devices")
    )


def map_frames(frames: DataFrame, mapping: DataFrame, width: int = 1000) -> DataFrame:
    """Each frame with the source position of the nearest mapping at or before its column on its line.

    Frames and mappings of a (file, line) are put in column order together and the last mapping is
    carried forward, in slices of columns, so a minified file with one long line is still split up.
    ``mapping`` has file, line, generated_column, source, source_line, source_column.
    """
    target = F.struct("source", "source_line", "source_column")
    places = mapping.select("file", "line", F.col("generated_column").alias("column"), F.lit(0).alias("_frame"), target.alias("_target"))
    asked = frames.withColumn("_frame", F.lit(1)).withColumn("_target", F.lit(None).cast(places.schema["_target"].dataType))
    both = asked.unionByName(places, allowMissingColumns=True)
    carried = (
        SegmentedScan(both, ["file", "line"], ["column", "_frame"], F.floor(F.col("column") / width))
        .running_last("_at", F.col("_target"))
        .done()
        .filter("_frame = 1")
    )
    return carried.select(*frames.columns, "_at.source", "_at.source_line", "_at.source_column")


