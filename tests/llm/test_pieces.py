import random

import pytest
import sentencepiece
from helpers import clash, docs

from tidemark.llm import pieces
from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_pieces(pieces.MODEL_PATH)


def best_score(coder, text):
    """Greatest sum of scores over all ways to part a text, by looking at every substring."""
    score = {t: s for t, s in zip(coder.pieces.texts, coder.pieces.scores) if t}
    longest = max(map(len, score))
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = [best[end - 1] + coder.unknown]
        ways += [best[k] + score[text[k:end]] for k in range(max(0, end - longest), end) if text[k:end] in score]
        best.append(max(ways))
    return best[-1]


def path_score(coder, ids):
    """Sum of scores of ids; a run of bytes is one unknown cost a character."""
    total, raw = 0.0, b""
    of_byte = {i: b for b, i in enumerate(coder.pieces.byte_ids)}
    for i in [*ids, None]:
        if i in of_byte:
            raw += bytes([of_byte[i]])
            continue
        total += coder.unknown * len(raw.decode())
        raw = b""
        total += coder.pieces.scores[i] if i is not None else 0
    return total


TEXTS = [
    "", " ", "   ", "a", "Hello world", "  two  spaces  ", "tab\tline\nend", "▁literal ▁ mark", "naïve Éêè 漢字 🙂 \x00 \x7f", "<s> <unk> <0x41> </s>",
    "supercalifragilistic" * 3, "x" * 5000, "word " * 3000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_and_best_score(vocabulary, text):
    coder = pieces.Coder(vocabulary)
    ids = coder.encode(text)
    assert coder.decode(ids) == text
    assert path_score(coder, ids.tolist()) == (best_score(coder, " " + text) if text else 0)


def test_random_texts(vocabulary):
    r = random.Random(1)
    coder = pieces.Coder(vocabulary)
    for _ in range(300):
        text = "".join(r.choices("abcdeht  \n.é▁漢", k=r.randint(0, 30)))
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        assert path_score(coder, ids.tolist()) == (best_score(coder, " " + text) if text else 0)


def test_small_vocabularies():
    ties = pieces.Pieces(("", "a", "b", "ab", " ", "ba"), (0, -1.0, -1.0, -2.0, 0.0, -2.0), (), 0)
    coder = pieces.Coder(ties)
    assert coder.encode("aba").tolist() == [4, 1, 5]  # among equal sums the longer last piece
    assert coder.encode("z").tolist() == [4, 0] and coder.decode([4, 0]) == "�"
    across = pieces.Pieces(("", "a", "a b", " ", "b"), (0, -1.0, -0.5, -1.0, -1.0), (), 0)
    assert pieces.Coder(across).encode("a b").tolist() == [3, 2]  # a piece over a space keeps texts whole
    nothing = pieces.Coder(pieces.Pieces(("",), (0.0,), (), 0))
    assert nothing.encode("ab").tolist() == [0, 0, 0]


def test_memo_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 8)
    coder = pieces.Coder(vocabulary)
    text = " ".join(str(i) for i in range(200))
    assert coder.decode(coder.encode(text)) == text
    assert max(len(g) for m in (coder.words, coder.parts) for g in (m.young, m.old)) <= 16


def test_pieces_are_those_of_the_file(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    assert len(vocabulary.texts) == model.get_piece_size()
    coder = pieces.Coder(vocabulary)
    ids = coder.encode("The library reads the same ids").tolist()
    assert model.decode(ids) == "The library reads the same ids"


def test_frames(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (1, TEXTS[1]), (None, "x")]
    table = clash(docs(spark, rows))
    coded = pieces.with_text(pieces.with_pieces(table, vocabulary), vocabulary)
    for r in coded.collect():
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
    for r in pieces.with_checked_pieces(table, vocabulary).collect():
        assert r.coded.same and (r.coded.ids is None) == (r.text is None)
    assert pieces.with_pieces(table.where("false"), vocabulary).count() == 0


def test_query_on_given_table(spark):
    found = QUERIES["op5_piece_coding"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.round_trip and r.n_pieces > 0 for r in found)
