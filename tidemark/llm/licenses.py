"""Licence scan: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, release


@dataclass(frozen=True)
class Notice:
    phrase: str  # words, lower case, single spaces
    label: str
    strength: float  # how surely the phrase states a licence
    base: bool = False


BASE = (
    Notice("under the mit license", "mit", 0.9, True),
    Notice("apache license version 2", "apache-2", 0.9, True),
    Notice("cc by nc", "cc-by-nc", 0.8, True),
)
MORE = (
    Notice("permission is hereby granted free of charge", "mit", 0.9),
    Notice("gnu general public license version 2", "gpl-2", 0.9),
    Notice("gnu general public license version 3", "gpl-3", 0.9),
    Notice("gnu lesser general public license", "lgpl", 0.9),
    Notice("gnu affero general public license", "agpl", 0.9),
    Notice("mozilla public license", "mpl", 0.8),
    Notice("eclipse public license", "epl", 0.8),
    Notice("redistribution and use in source and binary forms", "bsd", 0.9),
    Notice("under the isc license", "isc", 0.8),
    Notice("boost software license", "bsl", 0.8),
    Notice("creative commons attribution sharealike", "cc-by-sa", 0.8),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 0.8),
    Notice("cc by sa", "cc-by-sa", 0.7),
    Notice("cc by nd", "cc-by-nd", 0.7),
    Notice("cc0", "cc0", 0.7),
    Notice("released into the public domain", "public-domain", 0.7),
    Notice("all rights reserved", "all-rights-reserved", 0.4),
)
TAG = "spdx license identifier"
TAG_STRENGTH = 0.95

# How free the use is: 3 with few duties, 2 copyleft, 1 limited use, 0 not known or none.
FREEDOM = {
    "mit": 3, "apache-2": 3, "apache-2.0": 3, "bsd": 3, "bsd-2-clause": 3, "bsd-3-clause": 3, "isc": 3, "bsl": 3, "cc0": 3,
    "bsl-1.0": 3, "cc0-1.0": 3, "public-domain": 3, "unlicense": 3, "zlib": 3, "cc-by-4.0": 3, "lgpl": 2, "mpl": 2, "epl": 2,
    "gpl-2": 2, "gpl-3": 2, "agpl": 2, "mpl-2.0": 2, "epl-2.0": 2, "cc-by-sa": 2, "cc-by-nc": 1, "cc-by-nd": 1,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_GAPS = bytes(c if chr(c).isascii() and chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
_TO_WORDS = bytes(_GAPS[c] + 0x20 if 0x41 <= c <= 0x5A else _GAPS[c] for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LEAD = re.compile(r"[ \t:]*")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:\-]*)")


def freedom_of(label: str) -> int:
    """Class of a licence name; version endings do not matter for the families of copyleft licences."""
    if label in FREEDOM:
        return FREEDOM[label]
    family = re.match(r"(agpl|lgpl|gpl|cc-by-nc|cc-by-nd|cc-by-sa)\b", label)
    return {"agpl": 2, "lgpl": 2, "gpl": 2, "cc-by-sa": 2}.get(family[1], 1) if family else 0


Token = tuple[str, bool]  # a licence name, or an operator


def parse_expression(text: str, begin: int = 0) -> tuple[list[str], str, int] | None:
    """Read a licence expression that begins at a place of ``text`` with the shunting-yard algorithm; it ends with its line at the latest.

    Returns the licence names in order, the expression in postfix form and its freedom: ``or`` takes the freest side, ``and``
    the least free, ``with`` keeps its licence, one class freer for a copyleft licence. Reading ends where no
    token fits; a dangling operator or open bracket is left out. None if no licence name is there.
    """
    out: list[Token] = []
    waiting: list[str] = []
    operand_next, at = True, begin
    while match := _TOKEN.match(text, at):
        token = match[1]
        word = token.lower()
        if word in PRECEDENCE and token not in ("(", ")"):
            if operand_next:
                break
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                out.append((waiting.pop(), True))
            waiting.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            waiting.append("(")
        elif token == ")":
            if operand_next or "(" not in waiting:
                break
            while waiting[-1] != "(":
                out.append((waiting.pop(), True))
            waiting.pop()
        else:
            if not operand_next:
                break
            out.append((word.rstrip(".:"), False))
            operand_next = False
        at = match.end()
    if operand_next:  # what waits for an operand that never came
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    out += [(op, True) for op in reversed(waiting) if op != "("]
    return evaluate(out)


def join_labels(labels: list[str], links: list[str]) -> list[Token]:
    """Postfix form of labels, whatever their characters, with ``and`` or ``or`` between each and the next."""
    out: list[Token] = [(labels[0], False)]
    waiting: list[str] = []
    for link, label in zip(links, labels[1:], strict=True):
        while waiting and PRECEDENCE[waiting[-1]] >= PRECEDENCE[link]:
            out.append((waiting.pop(), True))
        waiting.append(link)
        out.append((label, False))
    return out + [(op, True) for op in reversed(waiting)]


def evaluate(postfix: list[Token]) -> tuple[list[str], str, int] | None:
    """Names, postfix text and freedom of an expression in postfix form."""
    names: list[str] = []
    stack: list[int] = []
    exceptions = {i - 1 for i, token in enumerate(postfix) if token == ("with", True)}
    for i, (token, operator) in enumerate(postfix):
        if operator and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            free = {"or": max(left, right), "and": min(left, right), "with": 3 if left == 2 else left}
            stack.append(free[token])
        elif not operator:
            stack.append(freedom_of(token))
            if i not in exceptions:
                names.append(token)
    return (names, " ".join(token for token, _ in postfix), stack[-1]) if names and len(stack) == 1 else None


@lru_cache(maxsize=8)
def _automaton(notices: tuple[Notice, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by_phrase: dict[str, list[int]] = {}
    for i, notice in enumerate(notices):
        by_phrase.setdefault(notice.phrase, []).append(i)
    by_phrase.setdefault(TAG, []).append(-1)
    for phrase, which in by_phrase.items():
        # Bytes as Latin-1 letters: the automaton then runs on UTF-8 without decoding it.
        found.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase.encode()) + 1, which))
    found.make_automaton()
    return found


def scan(text: str | None, notices: tuple[Notice, ...]) -> tuple:
    """Digest of one text: words, base places, first and last of them, base labels, labels, score, expressions, freedom."""
    raw = (text or "").encode()
    words = raw.translate(_TO_WORDS).split()
    flat = b" " + b" ".join(words) + b" "
    hits = [
        (end - length, which) for end, (length, each) in _automaton(notices).iter(flat.decode("latin-1")) for which in each
    ]
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, "", None
    base, base_labels, labels, found = [], set(), {}, []
    at = passed = 0
    for start, which in sorted(hits):
        at, passed = at + flat.count(b" ", passed, start), start
        if which < 0:
            found.append((at, None))
            continue
        notice = notices[which]
        labels[notice.label] = max(labels.get(notice.label, 0.0), notice.strength)
        found.append((at, notice))
        if notice.base:
            base.append(at)
            base_labels.add(notice.label)
    readings: list[tuple[str, int]] = []
    if any(notice is None for _, notice in found):
        spots = list(_WORD.finditer(text))
        for at, notice in found:
            if notice is None:
                if read := parse_expression(text, _LEAD.match(text, spots[at + 2].end()).end()):
                    readings.append(read[1:])
                    for name in read[0]:
                        labels[name] = max(labels.get(name, 0.0), TAG_STRENGTH)
    readings += _join_notices(sorted((x for x in found if x[1]), key=lambda x: x[0]), words)
    score = 1.0
    for strength in sorted(labels.values()):
        score *= 1.0 - strength
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(labels)), 1.0 - score if labels else 0.0, "; ".join(text for text, _ in readings),
        min((free for _, free in readings), default=None),
    )


def _join_notices(found: list[tuple[int, Notice]], words: list[bytes]) -> list[tuple[str, int]]:
    """Notices with only ``and`` or ``or`` (and articles) between them make one expression, read like a written one."""
    readings: list[tuple[str, int]] = []
    labels: list[str] = []
    links: list[str] = []
    for i, (at, notice) in enumerate(found):
        link = b""
        if i:
            before, earlier = found[i - 1]
            begin = before + len(earlier.phrase.split())
            between = [w for w in words[begin:at] if w not in _FILLERS]
            link = between[0] if len(between) == 1 and between[0] in (b"and", b"or") else b""
        if link:
            links.append(link.decode())
        elif labels:
            readings.append(evaluate(join_labels(labels, links))[1:])
            labels, links = [], []
        labels.append(notice.label)
    if labels:
        readings.append(evaluate(join_labels(labels, links))[1:])
    return readings


_FILLERS = (b"the", b"a", b"0", b"under", b"license")


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("expressions", T.StringType()),
    T.StructField("freedom", T.LongType()),
])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = (*BASE, *MORE)) -> DataFrame:
    """Licence findings of every whole text, one row per row of ``docs``; other columns are left out.

    Words are runs of ASCII letters and digits and of any other than ASCII characters, after lower-casing A-Z. A
    phrase counts at every place where its words stand consecutively, overlaps included. ``labels`` holds the names of
    all phrases and of tagged expressions, ``score`` is 1 minus the product of (1 - strength) over the labels, and
    ``freedom`` the least free reading of all expressions. A NULL text counts as empty: no words, no labels, score 0.
    Repeated rows each give their row. No shuffle: texts are read where they lie.
    """

    @F.pandas_udf(RESULT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan(t, notices) for t in texts], columns=RESULT.names)
            for name in ("first_word", "last_word", "freedom"):
                out[name] = out[name].astype("Int64")
            yield out
            release()

    return in_batches(docs).select(F.col(id_col), found(F.col(text_col)).alias("__found")).select(id_col, "__found.*")
