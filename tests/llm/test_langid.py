import random
import zlib

import numpy as np
import pytest
from helpers import clash, docs
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.queries import QUERIES

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "lich", "ver"], "cc": ["çe", "éa", "oui", "tre"]}


def speech(lang, seed, words=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(words))


def plain_phrases(text, sample):
    """Greedy longest matches by search."""
    n, at, phrases = len(text), 0, 0
    while at < n:
        size = 1
        while at + size < n and text[at: at + size + 1] in sample:
            size += 1
        phrases += 1
        at += size
    return phrases


def test_phrases_match_plain_search():
    model = langid.LanguageModel({lang: speech(lang, 0) for lang in SYLLABLES})
    texts = [speech("aa", 1, 20), speech("bb", 2, 9) + " " + speech("cc", 3, 5), "x", "", "ka" * 40, "?!"]
    counts, lengths, lettered = model.phrases(texts)
    to_class, _, _, _, langs, _ = model.build()
    for j, lang in enumerate(langs):
        sample = "".join(chr(c) for c in to_class[langid.folded(model.texts[lang])])
        for i, text in enumerate(texts):
            coded = "".join(chr(c) for c in to_class[langid.folded(text)])
            # A class the sample does not have ends a phrase of its own.
            assert counts[j][i] == plain_phrases(coded, sample), (lang, text)
    assert lengths.tolist() == [len(t) for t in texts]
    assert lettered.tolist() == [True, True, True, False, True, False]


def test_scripts_of_many_letters_are_told_apart():
    alphabets = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "bg": "абвгдежзийклмнопрстуфхцчшщъюя", "fr": "abcdefghijklmnopqrstuvwxyzàâçéèêëîïôûùü"}
    alphabets |= {"zh": "".join(map(chr, range(0x4E00, 0x4F90))), "ja": "".join(map(chr, [*range(0x4E00, 0x4F90), *range(0x3042, 0x3090)])), "ko": "".join(map(chr, range(0xAC00, 0xAD90)))}
    words = {}
    for lang, letters in alphabets.items():
        r = random.Random(lang)
        words[lang] = ["".join(r.choices(letters, k=r.randint(2, 5))) for _ in range(200)]

    def text(lang, seed, n):
        return " ".join(random.Random(f"{lang}{seed}").choices(words[lang], k=n))

    model = langid.LanguageModel({lang: text(lang, 0, 1500) for lang in alphabets})
    asked = [(lang, text(lang, seed, 30)) for lang in alphabets for seed in range(1, 6)]
    found, scores, _ = model.predict([t for _, t in asked])
    assert found == [lang for lang, _ in asked]
    assert min(scores) > 0.2
    counts, _, _ = model.phrases([t for _, t in asked])
    for j, lang in enumerate(model.build()[4]):
        assert counts[j].tolist() == [plain_phrases(t, model.texts[lang]) for _, t in asked]


def test_automaton_holds_exactly_the_substrings():
    r = random.Random(5)
    codes = [r.randint(1, 3) for _ in range(60)]
    table = langid.suffix_automaton(codes, 4)
    text = "".join(map(str, codes))
    for _ in range(400):
        probe = [r.randint(1, 3) for _ in range(r.randint(1, 7))]
        state = 0
        for c in probe:
            state = int(table[state, c]) if state >= 0 else -1
            if state < 0:
                break
        assert (state >= 0) == ("".join(map(str, probe)) in text)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    return docs(spark, [*rows, (900, None, "aa"), (901, "", "bb"), (902, "12 34 !", None), (903, speech("cc", 7) * 300, None), (904, speech("aa", 904), None)])


def test_held_out_rows_are_told_apart(spark, corpus):
    model = langid.learn(langid.training_rows(corpus))
    found = {r.doc_id: r for r in langid.identify(clash(corpus), model).collect()}
    for i, lang in enumerate(list(SYLLABLES) * 40):
        assert found[i].language.lang_pred == lang
        assert 0 <= found[i].language.score <= 1
    assert [found[i].language.lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "cc", "aa"]
    assert [found[i].language.score for i in (900, 901, 902)] == [0, 0, 0]


def test_labels_of_held_out_rows_change_nothing(spark, corpus):
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held
    other = corpus.withColumn("lang", F.when(F.col("doc_id").isin(held), "zz").otherwise(F.col("lang")))
    assert langid.learn(langid.training_rows(other)).texts == langid.learn(langid.training_rows(corpus)).texts


def test_repeated_and_tied_rows_agree_and_nothing_learned_is_und(spark, corpus):
    twice = docs(spark, [(1, "kato mire", "aa"), (1, "kato mire", "aa"), (None, "kato mire", None)])
    model = langid.learn(corpus)
    assert len({r.language for r in langid.identify(twice, model).collect()}) == 1
    nothing = langid.learn(corpus.where("false"))
    assert {r.language.lang_pred for r in langid.identify(corpus, nothing).collect()} == {"und"}
    assert langid.identify(corpus.where("false"), model).count() == 0
    same = langid.LanguageModel({"m": "abcabc", "k": "abcabc"})
    assert same.predict(["abc"])[0] == ["k"] and same.predict(["abc"])[1] == [0.0]


def test_query_on_given_table(spark):
    found = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.001").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    assert len(found) == len(truth)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.95
    assert np.isfinite(both.score).all() and both.score.between(0, 1).all()
