"""Audience conditions: stored condition trees to Spark columns.

A tree is a list of groups, ``{"conditions": [row, ...]}``. Rows are joined by OR inside a group, groups
by AND. A row names a field, an operator, a value and a type; ``count`` rows compare how often something
happened and apply to a user's rows together, all others apply to single rows.

Each row is first read into a ``Term``, which holds only checked values. A table of readers by field id then gives
the column a term looks at, and the term's test is put on it.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators by id (fixed values).
OPERATORS: dict[int, Callable[[Column, Any], Column]] = {
    1: lambda c, v: c.rlike(str(v)),
    2: lambda c, v: c.startswith(F.lit(v)),
    3: lambda c, v: c.endswith(F.lit(v)),
    4: lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    5: lambda c, v: c == F.lit(v),
    6: lambda c, v: c > F.lit(v),
    7: lambda c, v: c < F.lit(v),
    8: lambda c, v: c >= F.lit(v),
    9: lambda c, v: c <= F.lit(v),
}
EQUALS = 5
EVENT_CATEGORY = 9
FIRST_EVENT_FIELD = 91

# Fields by id that are plain columns (fixed values).
COLUMNS = {
    11: "is_first_open", 21: "platform", 22: "device_category", 23: "os_category", 24: "app_version", 25: "browser",
    51: "traffic_source", 52: "medium", 53: "campaign", 61: "event_name", 62: "is_important_event",
}
# Page-view fields: the JSON keys whose texts are put together (fixed values).
PAGE_VIEW = {31: ("page_name",), 32: ("path", "query"), 33: ("host",)}
# Words of flag fields: those for 1 and those for 0; without the latter every other word is 0 (fixed values).
YES = ("true", "1", "t", "y", "yes")
FLAGS: dict[int, tuple[tuple[str, ...], tuple[str, ...] | None]] = {
    11: (("rew", "new", "입"), ("returning",)), 12: (YES, None), 62: (YES, None),
}


def user_status(ts: Column, as_of: dt.datetime) -> Column:
    """active up to 30 days before ``as_of``, sleep up to 60, else dropoff."""
    return (
        F.when(ts >= F.lit(as_of - dt.timedelta(days=30)), "active")
        .when(ts >= F.lit(as_of - dt.timedelta(days=60)), "sleep")
        .otherwise("dropoff")
    )


def _number(value: Any, read: type = float) -> Any:
    try:
        return read(value)
    except (TypeError, ValueError):
        return None


def _word(value: Any) -> str | None:
    return None if value is None else str(value).strip() or None


def _flag(field_id: int | None, word: str) -> Any:
    yes, no = FLAGS.get(field_id, ((), ()))
    if word.lower() in yes:
        return 1
    return 0 if no is None or word.lower() in no else word


@dataclass(frozen=True)
class Term:
    """One checked condition row. ``options`` holds several values when any of them may match."""

    field_id: int | None
    name: str
    operator: int
    counted: bool
    event: bool
    blank: bool
    options: tuple
    several: bool

    @classmethod
    def read(cls, row: Mapping[str, Any]) -> Term | None:
        """The term of a row, None when it lacks a usable operator or value."""
        field_id = _number(row.get("fieldId") or row.get("id"), int)
        event = _number(row.get("categoryId"), int) == EVENT_CATEGORY
        operator = row.get("operator", EQUALS if event else None)
        operator = EQUALS if operator is None and event else operator
        name, given = _word(row.get("field")) or "", row.get("value")
        counted = row.get("type") == "count"
        several = isinstance(given, (list, tuple))
        read = _number if counted else _word
        options = tuple(v for v in map(read, given if several else (given,)) if v is not None)
        if not options and event and name and not counted:
            options, several = (name,), False
        if operator not in OPERATORS or not options:
            return None
        if not counted:
            options = tuple(_flag(field_id, v) for v in options)
        return cls(field_id, name, operator, counted, event, given in (None, ""), options, several)

    def test(self, value: Column) -> Column:
        return value.isin(*self.options) if self.several else OPERATORS[self.operator](value, self.options[0])


@dataclass(frozen=True)
class Field:
    """A resolved field: its value, and what else must hold for the row."""

    value: Column
    guard: Column | None = None


def _json(col: str, key: str, parsed: bool) -> Column:
    """Text under a key of a JSON column, which is text itself or a variant parsed before."""
    path = f"$['{key}']"
    return F.try_variant_get(F.col(col), path, "string") if parsed else F.get_json_object(F.col(col), path)


def _or_empty(*texts: Column) -> Column:
    return F.coalesce(*texts, F.lit(""))


def _plain(name: str, term: Term, as_of: dt.datetime, parsed: bool) -> Field:
    return Field(F.col(name))


def _page_view(keys: tuple[str, ...], term: Term, as_of: dt.datetime, parsed: bool) -> Field:
    return Field(F.concat(*[_or_empty(_json("event_params", key, parsed)) for key in keys]), F.col("event_name") == "page_view")


def _event(term: Term, as_of: dt.datetime, parsed: bool) -> Field:
    return Field(F.col("event_name") if term.blank else _or_empty(_json("event_params", "value", parsed)))


def _free_key(term: Term, as_of: dt.datetime, parsed: bool) -> Field | None:
    if not term.name:
        return None
    key = re.sub(r"[^\w-]", "_", term.name)
    return Field(_or_empty(_json("event_params", key, parsed), _json("user_properties", key, parsed)))


Reader = Callable[[Term, dt.datetime, bool], Field | None]
READERS: dict[int, Reader] = {
    **{number: partial(_plain, name) for number, name in COLUMNS.items()},
    **{number: partial(_page_view, keys) for number, keys in PAGE_VIEW.items()},
    12: lambda term, as_of, parsed: Field((F.length(_or_empty(F.col("user_id"))) > 0).cast("long")),
    13: lambda term, as_of, parsed: Field(_or_empty(_json("user_properties", "grade", parsed))),
    14: lambda term, as_of, parsed: Field(user_status(F.col("event_time"), as_of)),
}


def resolve_field(term: Term, as_of: dt.datetime, parsed: bool = False) -> Field | None:
    """Column of a term: by its field id, else by its name in the two JSON columns, which are variants if ``parsed``."""
    beyond = _event if (term.field_id or 0) >= FIRST_EVENT_FIELD else _free_key
    return READERS.get(term.field_id, beyond)(term, as_of, parsed)


@dataclass(frozen=True)
class CountTerm:
    """How many of a user's rows meet ``cond``, against the term's value."""

    cond: Column
    term: Term

    def column(self, rows: Column | None) -> Column:
        counted = F.count_if(self.cond if rows is None else self.cond & rows)
        return self.term.test(counted.cast("double"))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests)


def _all(tests: Sequence[Column]) -> Column:
    return reduce(Column.__and__, tests)


@dataclass
class Predicate:
    """``where`` on rows, and groups of counts over a user's rows."""

    where: Column | None = None
    having: list[list[CountTerm]] = field(default_factory=list)

    def having_column(self, rows: Column | None = None) -> Column | None:
        """Aggregate condition; ``rows`` limits which rows are counted."""
        return _all([_any([t.column(rows) for t in group]) for group in self.having]) if self.having else None


def _row_test(term: Term, found: Field) -> Column:
    """True or false for a row: the value's test, the field's guard, and the name of the event it is asked of."""
    parts = [term.test(found.value)]
    if found.guard is not None:
        parts.append(found.guard)
    if term.event and term.name:
        parts.append(F.col("event_name") == term.name)
    return F.coalesce(_all(parts), F.lit(False))


def build_predicate(groups: Sequence[Mapping[str, Any]] | None, as_of: dt.datetime, parsed: bool = False) -> Predicate:
    """Condition tree to row and count conditions. Rows that cannot be read are skipped, and groups left empty by that.

    ``parsed`` says that the JSON columns are variants, parsed once by ``decode.with_variants`` however many conditions look at them.
    """
    out, wheres = Predicate(), []
    for group in groups or ():
        terms = [term for row in group.get("conditions") or () if (term := Term.read(row))]
        found = [(term, place) for term in terms if (place := resolve_field(term, as_of, parsed))]
        tests = [_row_test(term, place) for term, place in found if not term.counted]
        counts = [
            CountTerm(F.col("event_name") == term.name if term.name else place.value.isNotNull(), term) for term, place in found if term.counted
        ]
        if tests:
            wheres.append(_any(tests))
        if counts:
            out.having.append(counts)
    out.where = _all(wheres) if wheres else None
    return out
