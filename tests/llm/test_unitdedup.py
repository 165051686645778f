import random

from helpers import clash, docs
from pyspark.sql import functions as F

from tidemark.llm import unitdedup
from tidemark.llm.queries import QUERIES


def plain(rows):
    """Kept text and merged spans of (id, text) rows, by one dictionary."""
    first = {}
    found = [(i, t, list(unitdedup.units(t))) for i, t in rows]
    for i, _, units in sorted(found, key=lambda x: (x[0] is not None, x[0])):
        for start, _, form in units:
            rank = (i is not None, i, start)
            first[form] = min(first.get(form, rank), rank)
    out = {}
    for i, text, units in found:
        spans, at, kept = [], 0, ""
        for start, end, form in sorted(units):
            if first[form] != (i is not None, i, start):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([start, end])
        for start, end in spans:
            kept += text[at:start]
            at = end
        out[i] = (None if text is None else kept + text[at:], [tuple(s) for s in spans])
    return out


def sentence(r, n=9):
    return " ".join("".join(r.choices("abcdefghijklmno", k=5)) for _ in range(n)).capitalize() + "."


def test_units_keep_offsets():
    text = "  Äb cd, ef gh IJ.  \n\nOne two three four five six seven. Eight nine ten.\nshort line"
    found = list(unitdedup.units(text))
    assert [(text[a:b], f.decode()) for a, b, f in found] == [
        ("Äb cd, ef gh IJ.", "äb cd ef gh ij"),
        ("One two three four five six seven. Eight nine ten.", "one two three four five six seven eight nine ten"),
        ("One two three four five six seven.", "one two three four five six seven"),
    ]
    assert list(unitdedup.units(None)) == list(unitdedup.units("")) == []


def test_repeated_lines_and_sentences_without_spaces_go(spark):
    line, first, second = "人工智能正在改变我们的日常生活和工作方式", "春天来了，花园里的花都开了。", "我们明天一起去北京看长城！"
    thai, url = "ประเทศไทยมีอากาศร้อนตลอดทั้งปี", "https://" + "x" * 90
    found = list(unitdedup.units(f"{first}{second}"))
    assert [f"{first}{second}"[a:b] for a, b, _ in found] == [first + second, first, second]
    # Full-width stops, commas and spaces do not part equal units.
    assert next(unitdedup.units("春天来了\u3000花园里的花都开了"))[2] == next(unitdedup.units(first))[2]
    rows = [(1, f"{line}\n{thai}\n{url}\n版权"), (2, f"{line}\n{thai}\n{url}\n版权"), (3, first + second), (4, "他说" + "今天是星期天的早上。" + second)]
    check(spark, rows)
    left = {x.doc_id: x.text for x in unitdedup.remove_repeated_units(docs(spark, rows)).collect()}
    assert left == {1: rows[0][1], 2: "\n\n\n版权", 3: first + second, 4: "他说今天是星期天的早上。"}


def check(spark, rows):
    table = docs(spark, rows)
    found = unitdedup.remove_repeated_units(table).collect()
    want = plain(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.text, [(s.start, s.end) for s in r.removed]) == want[r.doc_id], r.doc_id


def test_matches_plain_version(spark):
    r = random.Random(1)
    pool = [sentence(r, r.randint(3, 12)) for _ in range(25)]
    rows = [(i, "\n".join(" ".join(r.choices(pool, k=r.randint(0, 4))) for _ in range(r.randint(0, 5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, pool[0].upper()), (104, "x" * 100_000 + "\n" + pool[1] * 2000), (None, pool[2] + "\n" + pool[3])]
    check(spark, rows)


def test_shared_passage_inside_a_line_goes_but_once(spark):
    r = random.Random(2)
    passage = " ".join(sentence(r) for _ in range(6))
    rows = [(i, f"{sentence(r)} {sentence(r)[:-1]} {passage} {sentence(r)}") for i in range(5)]
    left = {x.doc_id: x.text for x in unitdedup.remove_repeated_units(docs(spark, rows)).collect()}
    tail = passage.split(". ", 1)[1]
    assert tail in left[0]
    assert all(len(left[i]) < len(rows[i][1]) - len(tail) * 0.9 for i in range(1, 5))


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    r = random.Random(3)
    a, b = sentence(r), sentence(r)
    rows = [(1, a), (1, a), (2, a), (1, b)]
    table = clash(docs(spark, rows)).withColumn("removed", F.lit(1))
    found = unitdedup.remove_repeated_units(table)
    assert found.columns == [c for c in table.columns if c != "removed"] + ["removed"]
    assert sorted((x.doc_id, x.text) for x in found.collect()) == sorted([(1, a), (1, a), (2, ""), (1, b)])
    assert unitdedup.remove_repeated_units(table.where("false")).count() == 0


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = plain(rows)
    found = QUERIES["op4_unit_dedup"](spark, path).collect()
    assert len(found) == len(rows) and any(x.n_removed for x in found)
    for x in found:
        text, spans = want[x.doc_id]
        assert x.spans == ";".join(f"{a}-{b}" for a, b in spans)
        assert (x.n_spans, x.n_removed) == (len(spans), sum(b - a for a, b in spans))
