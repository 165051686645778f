import random
import re
import time

import pytest
from helpers import clash, docs

from tidemark.llm.licenses import BASE, MORE, Notice, evaluate, parse_expression, scan
from tidemark.llm.queries import QUERIES

ALL = (*BASE, *MORE)


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for notice in BASE:
        want = notice.phrase.split()
        for i in range(len(words)):
            if words[i: i + len(want)] == want:
                places.append(i)
                labels.add(notice.label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "   ", "Released under the MIT License.", "under the mit licenses", "CC BY-NC 4.0 cc by nc cc by nc", "Apache License, Version 2.0",
    "apache license version 2" * 3, "É under\nthe\tMIT—License", "under the MIT license under the mit license", "a{under}the|mit~license", "x " * 50_000 + "cc by nc",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places_match_plain_search(text):
    assert scan(text, ALL)[:5] == plain(text)


def test_random_texts_match_plain_search():
    r = random.Random(1)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "version", "2", "cc", "BY", "nc", "-", "\n", "é", "0"]
    for _ in range(500):
        text = r.choice([" ", "-", "\n"]).join(r.choices(parts, k=r.randint(0, 40)))
        assert scan(text, ALL)[:5] == plain(text)


@pytest.mark.parametrize(("text", "postfix", "freedom"), [
    ("MIT", "mit", 3), ("MIT OR GPL-3.0-only", "mit gpl-3.0-only or", 3), ("MIT AND GPL-2.0", "mit gpl-2.0 and", 2),
    ("GPL-2.0 WITH Classpath-exception-2.0", "gpl-2.0 classpath-exception-2.0 with", 3),
    ("mit or isc and gpl-3", "mit isc gpl-3 and or", 3), ("(MIT OR ISC) AND CC-BY-NC-4.0", "mit isc or cc-by-nc-4.0 and", 1),
    ("MIT OR", "mit", 3), ("MIT OR (", "mit", 3), ("(MIT", "mit", 3), ("MIT) x", "mit", 3), ("Strange-1.0", "strange-1.0", 0), ("MIT more words", "mit", 3),
])
def test_expressions(text, postfix, freedom):
    assert parse_expression(text)[1:] == (postfix, freedom)


def test_nothing_to_read():
    assert parse_expression("") is None
    assert parse_expression("AND MIT") is None
    assert evaluate([("and", True)]) is None


def test_random_expressions_match_plain_evaluation():
    """The least and greatest of a bracketed expression by Python's own reading of ``&`` and ``|``."""
    r = random.Random(2)
    free = {"MIT": 3, "GPL-3": 2, "CC-BY-NC": 1, "Odd": 0}

    class Level(int):
        def __and__(self, other):
            return Level(min(int(self), int(other)))

        def __or__(self, other):
            return Level(max(int(self), int(other)))

    def build(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(list(free))
        inner = f"{build(depth - 1)} {r.choice(['AND', 'OR'])} {build(depth - 1)}"
        return f"({inner})" if r.random() < 0.5 else inner

    for _ in range(300):
        text = build(4)
        python = text.replace("AND", "&").replace("OR", "|")
        for name, level in free.items():
            python = re.sub(rf"(?<![\w-]){name}(?![\w-])", f"Level({level})", python)
        assert parse_expression(text)[2] == eval(python)


def test_tags_and_joined_notices():
    found = scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0\nnext", ALL)
    assert found[5] == "apache-2.0,gpl-2.0,mit" and found[7] == "mit apache-2.0 or gpl-2.0 and" and found[8] == 2
    found = scan("under the MIT license or the Apache License, Version 2.0", ALL)
    assert found[4] == "apache-2,mit" and found[7] == "mit apache-2 or"
    assert scan("under the MIT license. cc by nc", ALL)[7:] == ("mit; cc-by-nc", 1)
    assert scan("SPDX-License-Identifier:", ALL)[5:] == ("", 0.0, "", None)
    assert 0 < found[6] < 1


def test_labels_of_any_characters():
    odd = (Notice("strange words", "_x", 0.5), Notice("other words", "or", 0.5))
    got = scan("strange words and other words. Strange words", odd)
    assert got[5] == "_x,or" and got[7] == "_x or and; _x" and got[8] == 0


def test_many_notices_and_tags_in_one_line_take_no_longer_each():
    def seconds(n):
        text = "under the mit license or SPDX-License-Identifier: MIT OR Apache-2.0 x " * n
        begin = time.process_time()
        got = scan(text, ALL)
        assert got[1] == n and got[2] == 0 and got[3] == 14 * (n - 1)
        return time.process_time() - begin

    seconds(100)
    assert seconds(16_000) < 40 * max(seconds(1000), 0.005)


def test_frames(spark):
    rows = docs(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "cc by nc")])
    from tidemark.llm.licenses import scan_licenses

    found = scan_licenses(clash(rows)).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(TEXTS[r.doc_id])
    assert scan_licenses(rows.where("false")).count() == 0


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = QUERIES["op2_license_scan"](spark, path).collect()
    assert len(found) == len(texts) and any(r.labels for r in found)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id]) for r in found)
    assert all({*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1 for r in found)
