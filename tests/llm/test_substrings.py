import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from helpers import clash, docs

from tidemark.llm import substrings
from tidemark.llm.queries import QUERIES

LENGTH = substrings.LENGTH


def repeated(texts, length):
    count = collections.Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if count[t[i: i + length]] > 1] for t in texts]


def plain(texts):
    """Bytes removed, runs and kept bytes of each text, by counting all windows."""
    out = []
    for t, starts in zip(texts, repeated(texts, LENGTH)):
        gone = bytearray(len(t))
        for i in starts:
            gone[i: i + LENGTH] = b"\1" * LENGTH
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_expansion_matches_counting(seed):
    r = random.Random(seed)
    length = r.choice([1, 5, 8, 20, 40, 100])
    letters = b"abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 4, 26])]
    base = [bytes(r.choices(letters, k=r.randint(0, 150))) for _ in range(4)]
    texts = []
    for _ in range(r.randint(1, 8)):
        both = r.choice(base) + r.choice(base)
        a = r.randint(0, len(both))
        texts.append(both[a: a + r.randint(0, 200)])
    assert [x.tolist() for x in substrings.repeated_windows(texts, length)] == repeated(texts, length)


def test_segments_hold_every_window_once_and_equal_windows_share_keys():
    r = random.Random(1)
    shared = bytes(r.choices(b"abcd", k=1200))
    texts = [bytes(r.choices(b"abcd", k=r.randint(0, 3000))) + shared[: r.randint(0, 1200)] for _ in range(6)] + [b"", b"a" * 2500, b"abc" * 900]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    key_of, seen = {}, collections.Counter()
    for start, windows, keys, twice in substrings.segments(data, ends):
        for s, m, k, both in zip(start, windows, keys, twice):
            inside = [data[w: w + LENGTH].tobytes() for w in range(s, s + m)]
            assert both or len(set(inside)) == len(inside)
            for w, text in zip(range(s, s + m), inside):
                seen[w] += 1
                assert key_of.setdefault(text, k) == k
    begins = np.concatenate([[0], ends[:-1]])
    assert seen == collections.Counter(w for a, b in zip(begins, ends) for w in range(a, b - LENGTH + 1))


def corpus(r):
    def text(n):
        return "".join(r.choices("abcdefghij klmnoé", k=n))

    passage, copy = text(700), text(1500)
    edited = copy[:600] + "#" + copy[601:]
    rows = [text(300) + passage + text(200), text(50) + passage + text(800), copy, copy, edited, "abc" * 700, "z" * 1200, text(399), None, "", text(100) + passage[:399], passage * 3, text(2000)]
    return rows + [text(r.randint(0, 900)) + passage[150:] for _ in range(6)]


@pytest.mark.parametrize("large", [False, True])
def test_matches_counting(spark, large, monkeypatch):
    if large:  # every key counts as too large for a block
        monkeypatch.setattr(substrings, "BLOCK_BYTES", 500)
    texts = corpus(random.Random(2))
    found = {r.doc_id: r for r in substrings.remove_repeated_strings(clash(docs(spark, list(enumerate(texts)))), hash_only=True).collect()}
    want = plain([(t or "").encode() for t in texts])
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept.hex()) for i in range(len(texts))] == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    r = random.Random(4)
    text = "".join(r.choices("abcdef", k=500))
    table = docs(spark, [(1, text), (1, text), (None, "x" + text), (2, "short"), (2, "short")])
    found = substrings.remove_repeated_strings(table).collect()
    assert sorted((x.n_bytes, x.n_removed, bytes(x.kept)) for x in found) == [(5, 0, b"short"), (5, 0, b"short"), (500, 500, b""), (500, 500, b""), (501, 500, b"x")]
    assert substrings.remove_repeated_strings(table.where("false")).count() == 0
    alone = substrings.remove_repeated_strings(docs(spark, [(1, "".join(r.choices("abcdefgh", k=5000)))])).first()
    assert (alone.n_removed, alone.n_spans) == (0, 0)


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").collect()
    found = QUERIES["op10_substring_bwt"](spark, path).orderBy("doc_id").collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found] == plain([(x.text or "").encode() for x in rows])


def test_segments_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    monkeypatch.setattr(substrings, "STRIDE", 3000)
    r = random.Random(12)
    texts = [bytes(r.choices(b"ab", k=n)) if n % 2 else (b"period nine " * n)[:n] for n in (10, 2500, 900, 7001, 3000, 1201, 400, 9999, 2, 2999)]

    def of(batch):
        """Segments of each text, from its own begin."""
        ends = np.cumsum([len(t) for t in batch])
        found = [[] for _ in batch]
        for start, windows, key, twice in substrings.segments(np.frombuffer(b"".join(batch), np.uint8), ends):
            for s, w, k, d in zip(start.tolist(), windows.tolist(), key.tolist(), twice.tolist()):
                i = int(np.searchsorted(ends, s, side="right"))
                found[i].append((s - int(ends[i]) + len(batch[i]), w, k, d))
        return found

    alone = [of([t])[0] for t in texts]
    assert of(texts) == alone and of(texts[::-1]) == alone[::-1] and of(texts[1::2]) == alone[1::2]
    assert all(sum(w for _, w, _, _ in found) == max(0, len(t) - substrings.LENGTH + 1) for t, found in zip(texts, alone))


@pytest.mark.parametrize("seed", range(20))
def test_texts_apart_are_not_held_against_each_other(seed):
    r = random.Random(100 + seed)
    length = r.choice([1, 5, 20, 40, 100])
    base = [bytes(r.choices(b"abcd"[: r.choice([1, 2, 4])], k=r.randint(0, 300))) for _ in range(3)]
    texts = [r.choice(base)[r.randint(0, 30):] + bytes(r.choices(b"ab", k=r.randint(0, 90))) for _ in range(r.randint(1, 12))]
    apart = np.array([r.choice([-(1 << 63), 7, (1 << 63) - 1]) for _ in texts])
    found = substrings.repeated_windows(texts, length, apart)
    for kind in set(apart.tolist()):
        at = np.flatnonzero(apart == kind).tolist()
        assert [found[i].tolist() for i in at] == repeated([texts[i] for i in at], length)


def test_a_block_is_ordered_by_parts_of_whole_keys(monkeypatch):
    r = random.Random(5)
    shared = bytes(r.choices(b"abcdef", k=700))
    rows = pd.DataFrame([(k, shared[a: a + 600]) for k in range(40) for a in (0, 50, 90)], columns=["key", "bytes"])
    together, given = substrings.TOGETHER, []

    def counted(texts, length=LENGTH, apart=None):
        given.append((sum(map(len, texts)), set(apart.tolist())))
        return substrings_repeated(texts, length, apart)

    substrings_repeated = substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", counted)
    monkeypatch.setattr(substrings, "TOGETHER", 9000)
    found = list(substrings._block_spans(rows))
    assert together < substrings.BLOCK_BYTES and len(given) > 5 and max(n for n, _ in given) <= 9000 + 1800
    assert sum(len(keys) for _, keys in given) == len(set().union(*(keys for _, keys in given))) == 40
    assert found == [(3 * k + i, a, b) for k in range(40) for i, (a, b) in enumerate([(50, 600), (0, 600), (0, 560)])]


def test_hash_work_in_chunks_equals_work_at_once(monkeypatch):
    r = np.random.default_rng(6)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    data[1000:1900] = 97
    monkeypatch.setattr(substrings, "CHUNK", 100_000)
    whole = substrings._piece_hashes(data, 16)
    monkeypatch.setattr(substrings, "CHUNK", 64)
    hashes = substrings._piece_hashes(data, 16)
    assert (hashes == whole).all() and len(hashes) == 4985
    least = substrings._sliding_min(hashes, 45)
    assert least.tolist() == [hashes[i: i + 45].min() for i in range(len(hashes) - 44)]
    begin = np.arange(0, len(least), 3)
    want = [np.count_nonzero(hashes[i: i + 45] == least[i]) > 1 for i in begin]
    assert substrings._twice(hashes, begin, begin + 45, least[begin]).tolist() == want
    assert any(want) and not all(want)
    assert len(substrings._sliding_min(hashes[:44], 45)) == len(substrings._piece_hashes(data[:15], 16)) == 0
