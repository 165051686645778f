"""Streaming form of the page-visit builder: a device's open page, and an entry for each of its rows ahead of the watermark, are kept as state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark import logtypes as lt
from tidemark.functions import timegrid as tg
from tidemark.operators.session import PAGE_OPENERS, REQUESTS

_TEXTS = ["package_nm", "os_type", "app_ver", "device_model", "user_id", "req_url"]
_OPENING = ["server_type", "log_type"]
_SUMS = ["log_count", "error_count", "js_error_count", "crash_count", "request_count", "sum_cpu_usage", "sum_mem_usage"]
_ROW = [*_TEXTS, *_OPENING, "cpu_usage", "mem_usage"]
_OPEN = [*_TEXTS, *_OPENING, "page_start_tm", "page_no", *_SUMS, "page_end_tm", "finish_tm", "waterfall", "timer"]
_OUT = ["device_id", *_TEXTS, *_OPENING, "page_no", "page_start_tm", "page_end_tm", "intervaltime", "loading_time", *_SUMS, "event_count", "wtf_flag"]
_STRINGS = {*_TEXTS, "device_id", "wtf_flag"}
_ENDS = (lt.WEB_END, lt.NATIVE_PAGE_END)
_ERRORS = (lt.SCRIPT_ERROR, lt.WEB_ERROR, lt.HTTP_ERROR)


def _type(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType() if c in _STRINGS else T.LongType()) for c in names])


_PAGE = Row(*_OUT)


class _Pages(StatefulProcessor):
    """Folds a device's rows into pages in order of time, as far as the watermark has come."""

    def __init__(self, idle_ms: int, openers: tuple[int, ...], row_key: T.StructType):
        self.idle_ms, self.openers, self.row_key = idle_ms, openers, row_key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _type(_OPEN))
        self.waiting = handle.getMapState("waiting", self.row_key, _type(_ROW))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.updateValue((row["log_tm"], row["event_id"]), tuple(row[c] for c in _ROW))
        yield from self._fold(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._fold(key[0], timerValues.getCurrentWatermarkInMs())

    def _fold(self, device: str, passed: int) -> Iterator[Row]:
        kept = self.open.get() if self.open.exists() else None
        page = dict(zip(_OPEN, kept, strict=True)) if kept is not None else dict.fromkeys(_OPEN)
        ahead = None
        ready = []
        for at in self.waiting.keys():
            if at[0] <= passed:
                ready.append(tuple(at))
            else:
                ahead = at[0] if ahead is None else min(ahead, at[0])
        for at in sorted(ready):
            row = dict(zip(_ROW, self.waiting.getValue(at), strict=True))
            self.waiting.removeKey(at)
            if row["log_type"] in self.openers:
                if page["page_start_tm"] is not None:
                    yield self._closed(device, page)
                page |= {c: row[c] for c in (*_TEXTS, *_OPENING)} | dict.fromkeys((*_SUMS, "finish_tm", "waterfall"), 0)
                page |= {"page_start_tm": at[0], "page_end_tm": at[0], "page_no": (page["page_no"] or 0) + 1}
            if page["page_start_tm"] is not None:
                self._add(page, at[0], row)
        idle = page["page_start_tm"] is not None and ahead is None and page["page_end_tm"] + self.idle_ms <= passed
        if idle:
            yield self._closed(device, page)
            # Only the number of the device's last page outlives it.
            page["page_start_tm"] = None
        self._settle(page, passed, ahead)

    def _settle(self, page: dict, passed: int, ahead: int | None) -> None:
        """Keep the page and one timer: for the next waiting row, or for the time the page has idled out."""
        due = ahead if ahead is not None else page["page_end_tm"] + self.idle_ms if page["page_start_tm"] is not None else None
        due = None if due is None else max(due, passed + 1)
        if page["timer"] is not None and page["timer"] > passed and page["timer"] != due:
            self.handle.deleteTimer(page["timer"])
        if due is not None and page["timer"] != due:
            self.handle.registerTimer(due)
        page["timer"] = due
        if due is not None or page["page_no"] is not None:
            self.open.update(tuple(page[c] for c in _OPEN))
        else:
            self.open.clear()

    @staticmethod
    def _add(page: dict, at: int, row: dict) -> None:
        kind = row["log_type"]
        counted = kind != lt.RESOURCE_START
        page["log_count"] += counted
        page["error_count"] += kind in _ERRORS
        page["js_error_count"] += kind == lt.SCRIPT_ERROR
        page["crash_count"] += kind == lt.CRASH
        page["request_count"] += kind in REQUESTS
        if counted:
            page["sum_cpu_usage"] += row["cpu_usage"] or 0
            page["sum_mem_usage"] += row["mem_usage"] or 0
        page["page_end_tm"] = max(page["page_end_tm"], at)
        if kind in _ENDS:
            page["finish_tm"] = max(page["finish_tm"], at)
        if kind in lt.WEBPERF:
            page["waterfall"] = 1

    @staticmethod
    def _closed(device: str, page: dict) -> Row:
        made = page | {
            "device_id": device, "event_count": page["log_count"], "wtf_flag": "Y" if page["waterfall"] else "N",
            "intervaltime": page["page_end_tm"] - page["page_start_tm"], "loading_time": max(page["finish_tm"] - page["page_start_tm"], 0),
        }
        return _PAGE(*[made[c] for c in _OUT])

    def close(self) -> None:
        pass


def build_pages_stream(events: DataFrame, idle_ms: int = 30 * 60_000, openers: tuple[int, ...] = PAGE_OPENERS) -> DataFrame:
    """Closed pages of an event stream with a watermark on ``log_tm_dt``, in the columns of ``session.build_pages``.

    Rows wait until the watermark has passed them, so they are folded in order of time whatever batch brings them, and a row that
    comes twice meanwhile counts once. A page closes when the device opens the next one, or after ``idle_ms`` without rows.
    Each waiting row is an entry of state, written when it comes and removed when it is folded; devices without rows or a due timer
    are not touched. The stream's session has to keep state by entry, see ``streams.stateful_session``.
    """
    row_key = events.select("log_tm", "event_id").schema
    given = events.select("device_id", "log_tm", "event_id", "log_tm_dt", *_TEXTS, *[events[c].cast("long").alias(c) for c in _ROW if c not in _TEXTS])
    processor = _Pages(idle_ms, tuple(openers), row_key)
    pages = given.groupBy("device_id").transformWithState(processor, _type(_OUT), "Append", "EventTime")
    return pages.withColumn("log_date", tg.day_of("page_start_tm"))
