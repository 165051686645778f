"""Repeated lines and sentences: normalised units are hashed, digests grouped over all texts, the earliest occurrence stays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, release

LINE_WORDS = 5
SENTENCE_WORDS = 6
UNSPACED_CHARS = 2  # characters that count as a word in scripts written without spaces
LONG_CHARS = 12  # characters of a normalised form that count as a word in any script
# Stops of other scripts end a sentence where no space follows them.
_STOPS = ".!?\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u06d4\u061f\u1362\u1367\u104b\u17d4\u17d5"
_SENTENCE = re.compile(f"[^{_STOPS}]*[{_STOPS}]+|[^{_STOPS}]+")
# Punctuation and spaces of those scripts, full-width forms too.
_GAPS = re.compile(
    "[\u0964\u0965\u060c\u061b\u061f\u06d4\u0e2f\u0e5a\u0e5b\u104a\u104b\u1361-\u1368\u17d4-\u17da\u3000-\u3004\u3008-\u3020\u3030\u303d\u30a0\u30fb"
    "\ufe10-\ufe1f\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]"
)
# Thai, Lao, Tibetan, Myanmar, Khmer, Tai and Javanese letters, kana and ideographs.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_PLAIN = bytes(c if chr(c).isascii() and chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def units(text: str | None, line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and normalised form of each unit of a text: lines, and the sentences of lines with more than one.

    A unit is normalised to lower case words of letters and digits with single spaces, so case, punctuation and
    white space do not part equal units. Units of fewer words are left out: short ones repeat by chance. Two characters
    of a script without spaces count as a word, and so do twelve of any form, so that long runs without gaps are units
    too. Offsets count characters of the text; white space around a unit is outside it.
    """
    at = 0
    for line in (text or "").split("\n"):
        words = _words(line)
        if _enough(words, line_words):
            parts = _SENTENCE.findall(line)
            spans = [(at, line, words)]
            if len(parts) > 1:
                start = at
                for part in parts:
                    of_part = _words(part)
                    if len(of_part) < len(words) and _enough(of_part, sentence_words):
                        spans.append((start, part, of_part))
                    start += len(part)
            for start, part, of_part in spans:
                first = start + len(part) - len(part.lstrip())
                yield first, first + len(part.strip()), b" ".join(of_part)
        at += len(line) + 1


def _words(part: str) -> list[bytes]:
    lower = part.lower()
    if not lower.isascii():
        lower = _GAPS.sub(" ", lower)
    return lower.encode().translate(_PLAIN).split()


def _enough(words: list[bytes], least: int) -> bool:
    """Whether a unit of these words is long enough to be looked up."""
    if len(words) >= least:
        return True
    form = b" ".join(words)
    if len(form) < UNSPACED_CHARS * least:
        return False
    text = form.decode()
    unspaced = 0 if text.isascii() else len(_UNSPACED.findall(text))
    return len(text) >= LONG_CHARS * least or len(words) + unspaced // UNSPACED_CHARS >= least


UNIT = T.StructType([
    T.StructField("doc", T.StringType()), T.StructField("mark", T.LongType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
])


def _unit_rows(docs: DataFrame, line_words: int, sentence_words: int) -> DataFrame:
    """All units of (doc, mark, text) rows with a 128-bit digest each."""
    schema = T.StructType([docs.schema["doc"], *UNIT.fields[1:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, mark = batch["doc"], batch["text"], batch["mark"]
            of, start, end, digest = [], [], [], bytearray()
            for i in range(batch.num_rows):
                for first, last, form in units(text[i].as_py(), line_words, sentence_words):
                    of.append(i)
                    start.append(first)
                    end.append(last)
                    digest += xxhash.xxh3_128_digest(form)
                if len(of) >= 100_000 or i == batch.num_rows - 1:
                    halves = pa.array(memoryview(bytes(digest)).cast("q").tolist(), pa.int64())
                    pick = pa.array(of, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(pick), mark.take(pick), pa.array(start, pa.int32()), pa.array(end, pa.int32()), halves.take(pa.array(range(0, 2 * len(of), 2), pa.int32())), halves.take(pa.array(range(1, 2 * len(of), 2), pa.int32()))],
                        names=[f.name for f in schema.fields],
                    )
                    of, start, end, digest = [], [], [], bytearray()
            release()

    return in_batches(docs).select("doc", "mark", "text").mapInArrow(rows, schema)


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])


@F.pandas_udf(CUT)
def cut_spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text without the spans, and the spans merged, in order, by the offsets of the text given."""
    for texts, spans in batches:
        kept, removed = [], []
        for text, found in zip(texts, spans, strict=True):
            if found is None or not len(found):
                kept.append(text)
                removed.append([])
                continue
            merged, parts, at = _merged(list(found)), [], 0
            for start, end in merged:
                parts.append(text[at:start])
                at = end
            kept.append("".join([*parts, text[at:]]))
            removed.append([{"start": s, "end": e} for s, e in merged])
        yield pd.DataFrame({"text": kept, "spans": removed})
        release()


def remove_repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, sentence_words: int = SENTENCE_WORDS,
    out: str = "removed",
) -> DataFrame:
    """Remove every line and sentence that has an earlier occurrence, by id and then by offset; NULL ids come first.

    All columns stay; ``text_col`` holds what is left and ``out`` the removed stretches by original offset (replacing a column of that
    name). Rows equal in id and text are one document and treated alike. A NULL text stays NULL, an empty one empty.
    Digests are counted before they move, only repeated ones are looked up again, and a digest's group is never in one
    place: it is one minimum, then a join that splits a frequent digest over tasks.
    """
    names = docs.columns
    keyed = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c not in (text_col, out)]).alias("row"),
    )
    found = _unit_rows(keyed, line_words, sentence_words)
    rank = F.struct("doc", "mark", "start")
    repeated = (
        found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("d1", "d2", "first")
    )
    later = found.join(repeated, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first")))
    spans = later.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc").alias("of"), F.col("mark").alias("of_mark"), "spans")
    joined = keyed.join(spans, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    result = joined.select("row", cut_spans(F.col("text"), F.col("spans")).alias("cut"))
    return result.select(*[F.col("cut.text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in names if c != out], F.col("cut.spans").alias(out))


def spans_text(spans: Column) -> Column:
    """Spans as ``start-end`` joined by ``;``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ";")
