"""The pipeline's stages against plain versions of them, each on the stage's own input."""

import random

import corpus_pipeline
import pytest
from helpers import clash, docs
from test_simhash import brute, plain_fingerprint
from test_unitdedup import plain as plain_units

from tidemark.llm import pieces

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows after each stage, by id, and the last frame."""
    folder = tmp_path_factory.mktemp("stages")
    now = spark.read.parquet(f"{PATH}/documents.parquet")
    out, columns = [now.toPandas().set_index("doc_id")], now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, PATH).write.parquet(str(folder / name))
        now = spark.read.parquet(str(folder / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
        out.append(now.toPandas().set_index("doc_id"))
    return out


def test_stages_are_those_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "unit_dedup", "decontaminate", "encode_pieces"]


def test_language_stage_keeps_texts_with_letters(steps):
    before, after = steps[0], steps[1]
    assert set(after.index) == {i for i, t in before.text.items() if t and any(c.isalpha() for c in t)}
    assert (after.text == before.text[after.index]).all()


def test_simhash_stage_keeps_the_first_of_each_group(steps):
    before = steps[1].sort_index()
    groups = brute([plain_fingerprint(t) for t in before.text])
    assert set(steps[2].index) == {before.index[g] for g in groups}


def test_unit_stage_cuts_later_copies(steps):
    before, after = steps[2], steps[3]
    want = plain_units(list(before.text.items()))
    kept = {i for i, (text, spans) in want.items() if not spans or text.strip()}
    assert set(after.index) == kept
    assert all(after.text[i] == want[i][0] and after.n_chars[i] == len(want[i][0]) for i in kept)


def test_decontamination_stage_drops_holders_of_items(spark, steps):
    before, after = steps[3], steps[4]
    items = [r.text for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    holders = {i for i, t in before.text.items() if any(item in t for item in items)}
    assert not holders & set(after.index)
    # What went besides verbatim holders still shares most of an item: its template windows are found by the operator's own tests.
    assert len(set(before.index) - set(after.index) - holders) <= 0.02 * len(before)


def test_encoding_stage_gives_ids_that_decode(spark, steps):
    before, after = steps[4], steps[5]
    coder = pieces.Coder(pieces.read_pieces(pieces.MODEL_PATH))
    assert set(after.index) == set(before.index)
    assert after.round_trip.all()
    for i in list(after.index)[:40]:
        assert coder.decode(list(after.ids[i])) == before.text[i]
        assert after.n_pieces[i] == len(after.ids[i]) == len(coder.encode(before.text[i]))


def test_run_gives_the_same_rows(spark, steps):
    got = corpus_pipeline.run(spark, PATH).toPandas().set_index("doc_id")
    assert set(got.index) == set(steps[5].index)
    assert all(list(got.ids[i]) == list(steps[5].ids[i]) for i in got.index)


def test_stages_take_odd_rows(spark):
    r = random.Random(1)
    words = [x.text for x in spark.read.parquet(f"{PATH}/documents.parquet").limit(3).collect()]
    rows = [(1, None), (2, ""), (3, "12 ?"), (4, words[0]), (4, words[0]), (5, words[0]), (None, words[1]), (6, words[1] + " " + words[2]), (7, "".join(r.choices("abcdefgh ", k=50_000)))]
    now = clash(docs(spark, rows))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, PATH)
        assert now.columns == clash(docs(spark, rows)).columns
    last = corpus_pipeline.STAGES[-1][1](spark, now, PATH).collect()
    assert sorted(str(x.doc_id) for x in last) == ["4", "6", "7", "None"]
    assert all(x.round_trip for x in last)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_an_empty_table(spark, number):
    empty = docs(spark, [(1, "x")]).where("false")
    assert corpus_pipeline.STAGES[number][1](spark, empty, PATH).count() == 0


