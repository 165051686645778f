import collections
import random
import re

from helpers import clash, docs
from pyspark.sql import functions as F

from tidemark.llm import divergence


def plain(rows, least=10, top=10):
    """Result rows by the contract, with Python's whole numbers."""
    given = [(r.text or "", r.lang or "", r.source or "") for r in rows]
    out = []
    for lang in {g[1] for g in given}:
        own = [(text, source) for text, of, source in given if of == lang]
        lower = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.encode().lower().decode()), s) for t, s in own]
        holders = collections.Counter(w for words, _ in lower for w in set(words))
        kept = {w for w, n in holders.items() if n >= least}
        counts = collections.defaultdict(collections.Counter)
        for words, source in lower:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), collections.Counter())

        def shares(c, kept=kept):
            return {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(whole)
        of = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(f(of[s][w], of[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            words = [(-f(of[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and of[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def sourced(table):
    """Several sources per language, some NULL or empty, one with a third of all rows."""
    n = F.pmod(F.xxhash64("doc_id", "text"), F.lit(60))
    return table.withColumn("source", F.when(n < 20, "hot").when(n == 20, None).when(n == 21, "").otherwise(F.concat(F.lit("sé"), n.cast("string"))))


def test_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmn" for b in "xyz"] + ["É", "été", "日本", "Ab", "a"]
    rows = [(i, " ".join(r.choices(vocabulary[: r.randint(3, len(vocabulary))], k=r.randint(0, 60))) + r.choice(["", ".", "-12x", "\x7f\t"]), r.choice(["en", "en", "fr", None, "", "de"])) for i in range(900)]
    rows += [(5000, "w " * 60_000 + "A", "en"), (5001, None, "en"), (5001, None, "en"), (None, "ax ax", "fr"), (5002, "rare words only", "xx"), (5003, "", "xx")]
    rows += [(6000 + i % 2, "ax bx copies", "en") for i in range(300)]
    table = sourced(clash(docs(spark, rows)))
    assert result(divergence.source_divergence(table)) == plain(table.collect())


def test_many_groups_and_terms_take_many_cells(spark):
    """More sources and terms than a block holds, so that pairs come from several cells."""
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6000)]
    rows = [(i, " ".join(r.choices(vocabulary, k=400)), "en") for i in range(600)]
    table = docs(spark, rows).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 90).cast("string")))
    assert result(divergence.source_divergence(table)) == plain(table.collect())


def test_no_kept_term_gives_pairs_of_zero(spark):
    table = docs(spark, [(1, "a b"), (2, None), (3, "c")]).withColumn("source", F.col("doc_id").cast("string"))
    got = result(divergence.source_divergence(table))
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [("1", "2", 0, 1), ("1", "3", 0, 2), ("2", "1", 0, 1), ("2", "3", 0, 2), ("3", "1", 0, 1), ("3", "2", 0, 2)]


def test_empty_table(spark):
    got = divergence.source_divergence(docs(spark, [(1, "x")]).where("false"))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_shares_are_exact_for_huge_counts(spark):
    rows = [(0, 9 * 10**18, 5), (4 * 10**18 + 1, 9 * 10**18, 12_345_678), (7, 13, 3), (0, 0, 0)]
    frame = spark.createDataFrame(rows, "n long, total long, kept long")
    got = [r[0] for r in frame.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * kept) if kept else 1 for n, total, kept in rows]
