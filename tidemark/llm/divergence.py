"""How far the sources of a language diverge in their words: a cube of (group block, group block, term block) cells.

Term counts of each (language, source) group become slices of a group block and a term block. A slice is sent to every cell of its group
block; a cell adds up the divergence of its pairs of groups over its terms, and the cells of a pair are summed along the term axis.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, in_batches, release, run_folder

LEAST_DOCS = 10  # documents of its language that a kept term is in
TOP_TERMS = 10
UNIT = 1_000_000_000
GROUPS = 32  # groups of a block, on average
TERMS = 4096  # terms of a block, on average
HELD = 200_000  # counts that a task adds up before it sends them
# Letters and what is not ASCII make terms, A-Z lower-cased; the rest parts them.
_TERM_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a whole text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences of a term in a group and the group's documents that have it.

    ``docs`` has text, lang and source, none NULL. Each group also has a row with term NULL, which stands for its documents. Counts are added up in
    each task before they move.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, holders) in found.items():
                size = len(times)
                words = pa.array(list(times), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (size + 1), pa.string()), pa.array([source] * (size + 1), pa.string()),
                        pa.concat_arrays([words, pa.nulls(1, pa.string())]),
                        pa.array([*times.values(), 0], pa.int64()), pa.array([*(holders[w] for w in times), 0], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            found.clear()

        for batch in batches:
            held = 0
            for text, lang, source in zip(*[batch[c].to_pylist() for c in ("text", "lang", "source")], strict=True):
                times, holders = found.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text)
                times.update(words)
                holders.update(set(words))
                held += 1
                if held % 500 == 0 and sum(len(t) + 1 for t, _ in found.values()) > HELD:
                    yield from send()
            if sum(len(t) + 1 for t, _ in found.values()) > HELD:
                yield from send()
            release()
        yield from send()

    parts = in_batches(docs).select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact whatever the counts; 1 where nothing is kept."""
    up = F.lit(UNIT).cast("decimal(12,0)") * (n.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)"))
    down = total.cast("decimal(20,0)") + kept.cast("decimal(18,0)") * F.lit(2).cast("decimal(1,0)")
    return F.when(kept == 0, F.lit(1).cast("long")).otherwise(F.call_function("div", up, F.greatest(down, F.lit(1).cast("decimal(1,0)"))) + 1)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares; a square is below 2^63."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of groups in a cell, over its terms."""
    lang, low, high = rows["lang"].iloc[0], rows["low"].iloc[0], rows["high"].iloc[0]

    def dense(block: int) -> np.ndarray:
        """Shares by group and term; a term that a group lacks has the group's share of a term without occurrence."""
        own = rows[rows["block"] == block]
        heads = own[own["place"] < 0].sort_values("member")
        out = np.repeat(heads["p"].to_numpy(np.int64)[:, None], heads["width"].iloc[0], axis=1)
        filled = own[own["place"] >= 0]
        out[filled["member"].to_numpy(np.int64), filled["place"].to_numpy(np.int64)] = filled["p"].to_numpy(np.int64)
        return out

    left = dense(low)
    right = left if low == high else dense(high)
    out = []
    for i, p in enumerate(left):
        others = np.arange(i + 1 if low == high else 0, len(right))
        q = right[others]
        out.append((np.full(len(others), i), others, ((p - q) ** 2 // (p + q)).sum(axis=1)))
    a, b, value = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
    return pd.DataFrame({"lang": lang, "block": low, "member": a, "other_block": high, "other": b, "value": value})


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each source is from each other one of its language, and its most telling terms.

    Part ``pair`` has the other sources with the divergence summed over the language's kept terms, part ``term`` up to ``top`` terms that the source has
    more of than its language. Ranks go by value downwards, then by item as UTF-8 bytes. NULL text, language and source are empty ones; every row is a
    document, repeated rows too, ids play no part, and other columns are left out. A group without terms, or a language with none kept, still has its
    pairs, of value 0 in the latter case. An empty frame gives an empty frame.
    """
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    # As a columnar table the counts take a fraction of what a checkpoint would; rare terms are most of them.
    place = run_folder(docs.sparkSession, "term_counts")
    made = term_counts(given)
    made.write.parquet(place)
    counts = docs.sparkSession.read.schema(made.schema).parquet(place)
    found = counts.where("term IS NOT NULL")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = cut(kept)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    # Terms and groups lie in blocks by hash, so that no task numbers those of a whole language.
    in_block = Window.partitionBy("lang", "term_block")
    placed = (
        kept.join(langs, "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / TERMS))).repartition("lang", "term_block")
        .withColumn("place", F.row_number().over(in_block.orderBy("term")) - 1)
    )
    widths = placed.groupBy("lang", "term_block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    entries = found.select("lang", "source", "term", "n").join(placed, ["lang", "term"])
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang", "left")
    groups = groups.fillna(0, ["total", "kept"])
    n_groups = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUPS).alias("blocks"))
    members = Window.partitionBy("lang", "block")
    groups = cut(
        groups.join(n_groups, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
        .withColumn("member", F.row_number().over(members.orderBy("source")) - 1)
    )
    entries = cut(entries.join(groups.drop("kept"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"))))

    heads = groups.select(
        "lang", "blocks", "block", "member", share(F.lit(0), F.col("total"), F.col("kept")).alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)) - 1)).alias("term_block"),
    ).join(widths, ["lang", "term_block"], "left")
    slices = heads.select("lang", "blocks", "block", "term_block", "member", F.lit(-1).alias("place"), "p", F.coalesce("width", F.lit(0)).alias("width")).unionByName(
        entries.select("lang", "blocks", "block", "term_block", "member", "place", "p", F.lit(0).alias("width"))
    )
    sent = slices.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = sent.select("lang", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "term_block", "block", "member", "place", "p", "width")
    partial = cells.groupBy("lang", "low", "high", "term_block").applyInPandas(
        _cell, "lang string, block long, member long, other_block long, other long, value long",
    )
    summed = partial.groupBy("lang", "block", "member", "other_block", "other").agg(F.sum("value").alias("value"))
    both = summed.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "lang", *[F.when(F.col("way") == 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("block", "other_block"), ("member", "other"))],
        *[F.when(F.col("way") == 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("other_block", "block"), ("other", "member"))], "value",
    )
    names = groups.select("lang", "block", "member", "source")
    others = names.select("lang", F.col("block").alias("other_block"), F.col("member").alias("other"), F.col("source").alias("item"))
    pairs = both.join(names, ["lang", "block", "member"]).join(others, ["lang", "other_block", "other"])

    lang_share = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    telling = entries.withColumn("q", lang_share).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(of_group).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(telling, "term").where(F.col("rank") <= top))
