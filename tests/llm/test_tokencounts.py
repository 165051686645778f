import random

import numpy as np
import public_tokenizers
import pytest
from helpers import clash, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm import tokencounts
from tidemark.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", "\r\n", "a", "é", "日", "ß", "1", "23", "²", "!", "?", "-", " ", "　", "​", "\x00", "\x1c", "\x85", "😀", "<|endoftext|>", "the", "ing", "aaaa", "    ", "S", " "]


@pytest.fixture(scope="module")
def vocabulary():
    return tokencounts.read_vocabulary(FILE)


@pytest.fixture(scope="module")
def counter(vocabulary):
    return tokencounts.Counter(vocabulary)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_character_classes_are_the_librarys(vocabulary):
    splits = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    beside = {tokencounts.DIGIT: "1", tokencounts.OTHER: "!", tokencounts.QUOTE: "!", tokencounts.SPACE: "\n", tokencounts.BLANK: "\n"}
    wrong = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(splits(beside.get(int(vocabulary.classes[c]), "a") + chr(c))) != 1]
    assert not wrong


def test_state_maps_are_closed(counter):
    after, _ = tokencounts.splitter()
    maps = [tuple(m) for m in counter.maps.tolist()]
    assert maps[0] == tuple(range(12)) and len(set(maps)) == len(maps) < 100
    for i, first in enumerate(maps):
        for j, second in enumerate(maps):
            assert maps[counter.products[i, j]] == tuple(second[s] for s in first)
        for kind in range(12):
            assert maps[counter.of_kind[i, kind]] == tuple(int(after[s, kind]) for s in first)


def test_scan_equals_one_step_after_the_other(counter):
    r = np.random.default_rng(1)
    after, said = tokencounts.splitter()
    for n in (1, 2, 63, 64, 65, 1000, 20_000):
        kinds = r.integers(0, 12, n).astype(np.uint8)
        begins, state = np.zeros(n, bool), tokencounts.BEGIN
        for i, kind in enumerate(kinds):
            begins[i] |= bool(said[state, kind] & tokencounts.HERE)
            if said[state, kind] & tokencounts.BEFORE and i:
                begins[i - 1] = True
            state = after[state, kind]
        assert np.array_equal(counter.word_begins(kinds), begins)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(max_size=40) | st.lists(st.sampled_from(ODD), max_size=30).map("".join), min_size=1, max_size=8))
def test_any_text(counter, library, texts):
    assert counter.count_texts(texts) == library(texts)


def test_made_up_words(counter, library):
    r = random.Random(5)
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for letters in ("abcdefgh", "aeiou tnrs", "0123456789abcdef", "ABCxyz'", "éèüß ") for _ in range(1500)]
    texts += ["a" * k for k in range(150)] + [" " * k + x for k in range(50) for x in ("", "a", "\n", "!")]
    assert counter.count_texts(texts) == library(texts)


def test_long_texts_go_by_pieces(counter, library, monkeypatch):
    monkeypatch.setattr(tokencounts, "PIECE", 1000)
    r = random.Random(6)
    texts = ["".join(r.choices(ODD[:-8], k=5000)), "z" * 7000, "x'll " * 2000, " \n" * 3000, "'" * 2500, "a b" * 900]
    assert counter.count_texts(texts) == library(texts)


def test_full_tables_start_anew(vocabulary, library, monkeypatch):
    for states, longest in ((50, 1 << 16), (50, 20)):
        monkeypatch.setattr(tokencounts, "STATES", states)
        monkeypatch.setattr(tokencounts, "LONGEST", longest)
        monkeypatch.setattr(tokencounts, "MEMO", 20)
        small = tokencounts.Counter(vocabulary)
        r = random.Random(7)
        texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 400))) for _ in range(60)]
        assert small.count_texts(texts) == library(texts)
        assert len(small.counts) <= 20 and len(small.counts.transducer.states) < 600


def test_frames(spark, vocabulary, library):
    rows = [(1, None), (2, ""), (2, ""), (3, "x'll <|endoftext|><|endoftext|> end"), (None, "no id"), (4, "word " * 60_000), (4, "again"), (4, "again")]
    table = clash(docs(spark, rows))
    counted = tokencounts.with_token_counts(table, vocabulary)
    assert counted.columns == [*table.columns, "n_tokens"]
    assert sorted((r.text or "", r.n_tokens) for r in counted.collect()) == sorted(zip([t or "" for _, t in rows], library([t for _, t in rows]), strict=True))
    assert tokencounts.with_token_counts(table.where("false"), vocabulary).count() == 0


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokencounts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_given_table(spark, library):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    found = QUERIES["op11_token_counts"](spark, path).collect()
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {i: (len((t or "").encode()), want[i], want[i] > 512) for i, t in texts.items()}
