import hashlib
import random
import zlib

import pytest
from helpers import clash, docs

from tidemark.llm import merkle
from tidemark.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i: i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, n):
    for level in tree[:-1]:
        run = level[n // 8 * 8: n // 8 * 8 + 8]
        yield run[: n % 8], run[n % 8 + 1:]
        n //= 8


def plain(rows):
    """Result rows, in any order, by the contract."""
    by_lang = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes.fromhex(plain_leaf(r, r.text)))):
        by_lang.setdefault(r.lang, []).append(r)
    trees = {lang: levels([plain_leaf(r, r.text) for r in rs]) for lang, rs in by_lang.items()}
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for lang, rs in by_lang.items():
        for i, r in enumerate(rs):
            steps = [*path(trees[lang], i), *path(top, order.index(lang))]
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            h = plain_leaf(r, r.text.encode().lower().decode() if hit else r.text)
            for left, right in steps:
                h = sha("".join(left) + h + "".join(right))
            proof = sha("".join("".join(left + right) for left, right in steps))
            out.append((r.doc_id, trees[lang][0][i], trees[lang][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def sortable(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "Word", "w" * 40_000, "É|é:-"]), r.choice(["en", "en", "en", None, "", "fr", "zü"])) for i in range(300)]
    rows += [(7, "Same", "en")] * 40 + [(None, "A", "en")] * 3 + [(None, None, None), (2**60, "single", "one")]
    table = clash(docs(spark, rows))
    got = merkle.check_documents(table)
    assert sortable(got.collect()) == sortable(plain(docs(spark, rows).collect()))


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 1, "fr": 1}, {"en": 8, "fr": 9}, {"en": 4096, "fr": 4097}, {"en": 40_000, None: 5}])
def test_sizes(spark, sizes):
    rows = [(i, f"T{i}", lang) for k, (lang, n) in enumerate(sizes.items()) for i in range(k * 100_000, k * 100_000 + n)]
    table = docs(spark, rows)
    assert sortable(merkle.check_documents(table).collect()) == sortable(plain(table.collect()))


def test_many_groups(spark):
    rows = [(i, "x", f"l{i % 5000}") for i in range(6000)]
    table = docs(spark, rows)
    assert sortable(merkle.check_documents(table).collect()) == sortable(plain(table.collect()))


def test_proofs_lead_to_the_root(spark):
    table = docs(spark, [(i, f"text {i}", "en" if i % 3 else "fr") for i in range(700)])
    built = merkle.build(merkle.leaves_of(table))
    root = built.groups.first().root
    rows = merkle.proofs(built).collect()
    assert len(rows) == 700
    assert all(merkle.fold(r.leaf, r.steps) == root for r in rows)
    assert all(merkle.fold(sha("other"), r.steps) != root for r in rows)
    assert merkle.audit(built).where("NOT verified").count() == 0


def test_empty_table(spark):
    empty = docs(spark, [(1, "x")]).where("false")
    got = merkle.check_documents(empty)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0
    assert merkle.proofs(merkle.build(merkle.leaves_of(empty))).count() == 0


def test_query_on_given_table(spark):
    path = "/root/testdata/sf0.001"
    want = plain(spark.read.parquet(f"{path}/documents.parquet").collect())
    assert sortable(QUERIES["op13_merkle_manifest"](spark, path).collect()) == sortable(want)
