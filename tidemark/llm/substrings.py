"""Repeated byte strings: bounded interval expansion on Burrows-Wheeler transforms of texts that may share a string.

Every 400-byte window has a key, the least hash of the 128-byte pieces in it, so equal windows have equal keys wherever they stand.
Neighbouring windows of one key make a segment. Segments equal as a whole are settled by their digests. Of the others, one copy of each
goes to the block of its key, where a suffix order, its transform and the expansion find the windows that occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, in_batches, release

LENGTH = 400
PIECE = 128  # bytes of the pieces whose least hash is the key; a power of two from 8, below the length
LONGEST = 1024  # windows of a segment
BLOCK_BYTES = 1 << 20  # text a block holds on average, and most a key may bring into one
FILTER_BITS = 1 << 26
STRIDE = 1 << 21  # bytes hashed at a time
TOGETHER = 1 << 18  # bytes of a block's keys that are ordered at a time
CHUNK = 1 << 14  # values worked on at a time, so that they stay in a core's own cache
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _piece_hashes(data: np.ndarray, piece: int) -> np.ndarray:
    """Hash of the ``piece`` bytes from each position, by doubling 8-byte words."""
    n = len(data) - piece + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), 0, (1,))
    out = np.empty(n, np.uint64)
    for a in range(0, n, CHUNK):
        h = words[a: min(a + CHUNK, n) + piece - 8] * _MIX
        width = 8
        while True:
            h ^= h >> np.uint64(31)
            h *= _MIX2
            if width == piece:
                break
            h = h[:-width] * _MIX + h[width:]
            width *= 2
        np.bitwise_xor(h, h >> np.uint64(29), out=out[a: a + CHUNK])
    return out


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each position, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    out = np.empty(n, values.dtype)
    for a in range(0, n, CHUNK):
        m = min(CHUNK, n - a)
        part, span = values[a: a + m + width - 1], 1
        while 2 * span <= width:
            part = np.minimum(part[:-span], part[span:])
            span *= 2
        np.minimum(part[:m], part[width - span: width - span + m], out=out[a: a + m])
    return out


def _twice(hashes: np.ndarray, begin: np.ndarray, until: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key stands twice or more among the hashes from its ``begin`` to before its ``until``."""
    mask = np.uint64((1 << 20) - 1)
    asked = np.zeros(1 << 20, bool)
    asked[keys & mask] = True
    place = np.flatnonzero(asked[hashes & mask])  # all places of keys, and a few more
    low, high = np.searchsorted(place, begin), np.searchsorted(place, until)
    out = np.empty(len(keys), bool)
    for k in range(0, len(keys), 1024):  # in a periodic text every place may be one
        start, count = low[k: k + 1024], (high - low)[k: k + 1024]
        head = np.cumsum(count) - count
        each = place[np.arange(count.sum()) + np.repeat(start - head, count)]
        out[k: k + 1024] = np.add.reduceat((hashes[each] == np.repeat(keys[k: k + 1024], count)).astype(np.int32), head) > 1
    return out


def _stretches(ends: np.ndarray) -> list[tuple[int, int]]:
    """Parts of texts laid end to end that are hashed at a time: whole texts together, a longer text by fixed steps from its own begin.

    So where a text is cut depends on nothing but the text, whatever lies beside it.
    """
    out, begin, before = [], 0, 0
    for end in ends.tolist():
        if end - begin > STRIDE and before > begin:
            out.append((begin, before))
            begin = before
        while end - begin > STRIDE:
            out.append((begin, begin + STRIDE))
            begin += STRIDE
        before = end
    return [*out, (begin, before)] if before > begin else out


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Start, windows, key and whether the key's piece stands in it twice, of the segments of texts laid end to end.

    ``ends`` are where the texts end. A segment of m windows is m + length - 1 bytes long and lies in one text.
    """
    inner = length - piece + 1
    for base, until in _stretches(ends):
        part = data[base: until + length - 1]
        hashes = _piece_hashes(part, piece)
        least = _sliding_min(hashes, inner)[: until - base]
        if not len(least):
            continue
        valid = np.ones(len(least), bool)
        for end in ends[np.searchsorted(ends, base, side="right"): np.searchsorted(ends, base + len(least) + length)].tolist():
            valid[max(0, end - length + 1 - base): max(0, end - base)] = False
        # Before a text's begin stands the end of another, where no window starts, so a segment lies in one text.
        turn = np.ones(len(least), bool)
        turn[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        first = np.flatnonzero(valid & turn)
        if not len(first):
            continue
        stop = np.flatnonzero(valid & np.append(turn[1:] | ~valid[1:], True)) + 1
        parts = -(-(stop - first) // LONGEST)
        begin = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        until = np.minimum(begin + LONGEST, np.repeat(stop, parts))
        keys = least[begin]
        twice = _twice(hashes, begin, until + inner - 1, keys)
        yield begin + base, until - begin, keys.view(np.int64), twice


def _refine(order: np.ndarray, rank: np.ndarray, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Reorder ``rows`` of ``order`` by (rank, after) and rank them anew; returns which of them begin a class.

    Ranks are the first row of a class, so rows stay within their class and other rows keep their place.
    """
    n, m = len(order), len(rows)
    held = order[rows]
    by = rank[held].astype(np.int64) * (n + 1) + after
    bits = m.bit_length()
    if (n + 1) ** 2 << bits < 1 << 63:  # sorting numbers is much faster than sorting places
        by <<= bits
        by |= np.arange(m)
        by.sort()
        at = by & ((1 << bits) - 1)
        by >>= bits
    else:
        at = np.argsort(by)
        by = by[at]
    head = np.append(True, by[1:] != by[:-1])
    order[rows] = held = held[at]
    rank[held] = rows[np.maximum.accumulate(np.where(head, np.arange(m), 0))]
    return head


def repeated_windows(texts: list[bytes], length: int = LENGTH, apart: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text the starts of the windows that occur twice or more in the texts together.

    With ``apart``, a number for each text, windows are held only against those of texts with the same number.
    Suffixes are ordered by prefix doubling to at least ``length`` bytes. Then strings grow to the left: the interval of
    c + w follows from that of w through the transform, level by level, and the end of a new interval bounds the
    common prefix of the two suffixes there. Ends not reached below ``length`` are those of suffixes that share so much.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.size or sizes.max() < length:
        return [np.empty(0, np.int64) for _ in texts]
    # Each text is followed by its end mark 0; bytes count from 1.
    flat = np.frombuffer(b"\x00".join([*texts, b""]), np.uint8).astype(np.int16) + np.int16(1)
    marks = np.cumsum(sizes + 1) - 1
    flat[marks] = 0
    n = len(flat)
    small = np.int32 if n < 1 << 30 else np.int64
    place = np.arange(n, dtype=small)
    left = np.repeat(marks, sizes + 1).astype(small) - place  # bytes from here to the end of the text
    kinds, kind = np.unique(apart, return_inverse=True) if apart is not None else (np.zeros(1), np.zeros(len(texts), np.int64))
    key = np.repeat(kind.astype(np.int64), sizes + 1)
    width = 0
    while width < min(7, length) and len(kinds) * 257 ** (width + 1) < 1 << 62:
        key *= 257
        key[: n - width] += flat[width:] * (left[: n - width] >= width)
        width += 1
    order = np.argsort(key).astype(small)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])  # where a class of suffixes that agree to the depth so far begins
    rank = np.empty(n, small)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    bounded = None  # whether the common prefix of rows r - 1 and r is known to be shorter than the level
    while True:
        if bounded is None and (width >= 28 or 2 * width > length):
            bounded, start_width = np.append(head, True), width
        # A class of one row is settled, and so is one whose suffixes end within the depth.
        rows = np.flatnonzero(~(head & np.append(head[1:], True)))
        rows = rows[left[order[rows]] >= width]
        if width >= length or not len(rows):
            break
        held = order[rows]
        after = np.where(width >= left[held], 0, rank[np.minimum(held + small(width), n - 1)] + 1)
        head[rows] = _refine(order, rank, rows.astype(small), after)
        width *= 2
    if bounded is None:
        bounded, start_width = np.append(head, True), min(width, length)
    del key, rank
    # Rows of one class are in any order, so an interval reaches from the begin of a class to the end of one.
    class_low = np.maximum.accumulate(np.where(head, place, 0))
    class_high = np.minimum.accumulate(np.where(np.append(head[1:], True), place, n)[::-1])[::-1]
    row_of = np.empty(n, small)
    row_of[order] = place
    before = np.maximum(order - 1, 0)
    letter = np.where(order > 0, flat[before], 0)  # the transform; 0 where a text begins
    to = row_of[before]
    to_low, to_high = class_low[to], class_high[to]
    turn = np.append(True, letter[1:] != letter[:-1])
    run = np.cumsum(turn, dtype=small) - small(1)  # equal letters in a row make a run
    run_low = np.flatnonzero(turn)
    run_high = np.append(run_low[1:], n) - 1
    edge = np.flatnonzero(bounded)
    low, high = edge[:-1], edge[1:] - 1
    for _ in range(start_width, length):
        if not len(low):
            break
        # Runs in place of rows: the first row with a letter and the last one bound the interval of that letter.
        of_low = run[low]
        runs = run[high] - of_low + 1
        one = runs == 1
        first, last = low[one], high[one]
        grown = letter[first] > 0
        first, last = first[grown], last[grown]
        if not one.all():
            low, high, of_low, runs = low[~one], high[~one], of_low[~one], runs[~one]
            of = np.repeat(np.arange(len(low)), runs)
            each = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + of_low[of]
            begin, end = np.maximum(run_low[each], low[of]), np.minimum(run_high[each], high[of])
            its = letter[begin]
            grown = its > 0
            group = of[grown] * 257 + its[grown]
            by_group = np.argsort(group, kind="stable")
            group = group[by_group]
            head = np.append(True, group[1:] != group[:-1]) if len(group) else np.empty(0, bool)
            tail = np.append(head[1:], True) if len(group) else head
            first = np.concatenate([first, begin[grown][by_group[head]]])
            last = np.concatenate([last, end[grown][by_group[tail]]])
        low, high = to_low[first], to_high[last]
        new = ~bounded[high + 1]
        low, high = low[new], high[new]
        bounded[high + 1] = True
    shared = ~bounded[:-1] | ~bounded[1:]
    starts = np.sort(order[shared & (left[order] >= length)]).astype(np.int64)
    begin = np.concatenate([[0], marks[:-1] + 1])
    which = np.searchsorted(marks, starts)
    cuts = np.searchsorted(which, np.arange(len(texts) + 1))
    return [starts[cuts[i]: cuts[i + 1]] - begin[i] for i in range(len(texts))]


def _flat(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column laid end to end, and where each text ends; NULL is empty."""
    raw = [b"" if t is None else t for t in batch_text.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw])


def _rows(docs: DataFrame, fields: str, make: Callable, marks: Broadcast | None = None) -> DataFrame:
    """Rows that ``make`` gives for the segments of each text, of those texts only whose mark passes the filter ``marks``."""
    doc = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if marks is not None:
                batch = batch.filter(pa.array(_passes(marks.value, batch["mark"].to_numpy())))
            data, ends = _flat(batch["text"])
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            for start, windows, key, twice in segments(data, ends):
                which = np.searchsorted(ends, start, side="right")
                yield make(batch, data, which, start, start - begins[which], windows, key, twice)
            release()

    return in_batches(docs).select("doc", "mark", "text").mapInArrow(run, f"doc {doc}, mark long, {fields}")


def _digests(data: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    raw = data.data
    digest = b"".join([xxhash.xxh3_128_digest(raw[s: s + m + LENGTH - 1]) for s, m in zip(start.tolist(), windows.tolist(), strict=True)])
    halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _filter(hashes: DataFrame) -> Broadcast:
    """A bit for each value of column ``h``, in 8 MB whatever their number. What it lets pass in excess costs time only."""
    cells = hashes.select(F.col("h").bitwiseAND(FILTER_BITS - 1).alias("cell"))
    words = cells.selectExpr("shiftright(cell, 6) AS word", "shiftleft(1L, cast(cell & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _mix(*parts: np.ndarray) -> np.ndarray:
    """Hash of a row of numbers, the same in a task that writes the filter and in one that asks it."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.int64).view(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _block_spans(rows: pd.DataFrame) -> Iterator[tuple[int, int, int]]:
    """Row number, start and end in its text, of the stretches of a block's single segments that occur elsewhere in the block."""
    texts, keys = rows["bytes"].tolist(), rows["key"].to_numpy()
    # Equal windows have equal keys, so keys are ordered apart, a few whole ones at a time. Rows stand in order of key.
    turn = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    before = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[turn]
    part = turn[np.append(True, np.diff(before // TOGETHER) > 0)].tolist()
    for first, last in zip(part, [*part[1:], len(texts)], strict=True):
        for i, starts in enumerate(repeated_windows(texts[first:last], apart=keys[first:last]), first):
            if len(starts):
                head = np.flatnonzero(np.append(True, np.diff(starts) > 1))
                tail = np.append(head[1:], len(starts)) - 1
                for a, b in zip(starts[head].tolist(), starts[tail].tolist(), strict=True):
                    yield i, a, b + LENGTH


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Stretches (doc, mark, start, end, by) of (doc, mark, text) rows that are covered by strings of 400 bytes with another start anywhere.

    ``by`` says how a stretch was found: by the digest of a ``whole`` segment, ``expanded`` in a block, or by ``windows`` of a large key.
    """
    doc = docs.schema["doc"].dataType

    def summary(batch, data, which, start, at, windows, key, twice):
        d1, d2 = _digests(data, start, windows)
        pick = pa.array(which, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch["doc"].take(pick), batch["mark"].take(pick), pa.array(at.astype(np.int64)), pa.array(windows.astype(np.int32)), pa.array(key), d1, d2, pa.array(twice)],
            names=["doc", "mark", "start", "windows", "key", "d1", "d2", "twice"],
        )

    # Texts are hashed once for all that follows; what is left to do reads a row for each segment.
    every = cut(_rows(docs, "start long, windows int, key long, d1 long, d2 long, twice boolean", summary))
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    wanted = _filter(keys.where("n > 1 OR twice").select(F.col("key").alias("h")))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.filter(pa.array(_passes(wanted.value, batch["key"].to_numpy())))
            own = _mix(*[hit[c].to_numpy() for c in ("mark", "start", "windows")])
            yield hit.append_column("own", pa.array(own))

    found = cut(every.mapInArrow(passing, T.StructType([*every.schema.fields, T.StructField("own", T.LongType())])))
    classes = cut(found.groupBy("key", "d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.min("own").alias("own"), F.max("windows").alias("windows"), F.max("twice").alias("twice"),
    ))
    same = classes.where("n > 1").select("key", "d1", "d2")
    whole = found.join(same, ["key", "d1", "d2"]).select("doc", "mark", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"), F.lit("whole").alias("by"))

    by_key = classes.groupBy("key").agg(
        F.count(F.lit(1)).alias("forms"), F.sum(F.col("windows") + LENGTH).alias("bytes"), F.max("twice").alias("twice"), F.max(F.col("n") == 1).alias("single"),
    ).where("(forms > 1 AND single) OR twice")
    open_ = cut(classes.drop("twice", "windows").join(by_key.select("key", "bytes"), "key"))
    total = open_.agg(F.sum(F.lit(1)), F.count_if(F.col("bytes") > BLOCK_BYTES)).first()
    asked = _filter(open_.select(F.col("own").alias("h")))
    # Only texts with a segment that is asked for are hashed again.
    holders = _filter(found.join(open_.select("own").distinct(), "own", "left_semi").select(F.col("mark").alias("h")))

    def texts(batch, data, which, start, at, windows, key, twice):
        pick = pa.array(which, pa.int64())
        own = _mix(batch["mark"].take(pick).to_numpy(zero_copy_only=False), at, windows)
        hit = np.flatnonzero(_passes(wanted.value, key) & _passes(asked.value, own))
        which, start, at, windows, key, own = (x[hit] for x in (which, start, at, windows, key, own))
        d1, d2 = _digests(data, start, windows)
        pick = pa.array(which, pa.int64())
        raw = data.data
        return pa.RecordBatch.from_arrays(
            [batch["doc"].take(pick), batch["mark"].take(pick), pa.array(at.astype(np.int64)), pa.array(key), d1, d2, pa.array(own), pa.array([bytes(raw[s: s + m + LENGTH - 1]) for s, m in zip(start.tolist(), windows.tolist(), strict=True)], pa.binary())],
            names=["doc", "mark", "start", "key", "d1", "d2", "own", "bytes"],
        )

    sent = _rows(docs, "start long, key long, d1 long, d2 long, own long, bytes binary", texts, holders)
    sent = sent.join(open_.select("key", "d1", "d2", "own", "n", F.col("bytes").alias("weight")), ["key", "d1", "d2", "own"])
    spans = T.StructType([T.StructField("doc", doc), T.StructField("mark", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    n_blocks = max(1, int((total[0] or 0) * (LENGTH + 150) // BLOCK_BYTES))

    def in_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        out = [(i, a, b) for i, a, b in _block_spans(rows) if rows["n"][i] == 1]
        i = [x[0] for x in out]
        start = rows["start"].to_numpy()[i]
        return pd.DataFrame({"doc": rows["doc"].to_numpy()[i], "mark": rows["mark"].to_numpy()[i], "start": start + [x[1] for x in out], "end": start + [x[2] for x in out]})

    blocks = sent.where(F.col("weight") <= BLOCK_BYTES).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
    apart = blocks.groupBy("block").applyInPandas(in_block, spans).withColumn("by", F.lit("expanded"))
    result = whole.unionByName(apart)
    if total[1]:
        result = result.unionByName(_large_keys(sent.where(F.col("weight") > BLOCK_BYTES), spans).withColumn("by", F.lit("windows")))
    return result


def _large_keys(sent: DataFrame, spans: T.StructType) -> DataFrame:
    """The same stretches for keys too large for a block: windows are dealt by their own digests, counted before they move."""
    name = spans["doc"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch["bytes"][i].as_py()
                n = len(raw) - LENGTH + 1
                halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[k: k + LENGTH]) for k in range(n)]), np.int64).reshape(-1, 2)
                pick = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc"].take(pick), batch["mark"].take(pick), pa.array(batch["start"][i].as_py() + np.arange(n)), batch["n"].take(pick), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    names=["doc", "mark", "start", "n", "w1", "w2"],
                )

    windows = sent.select("doc", "mark", "start", "n", "bytes").mapInArrow(each, f"doc {name}, mark long, start long, n long, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    return windows.where("n = 1").join(twice, ["w1", "w2"]).select("doc", "mark", "start", (F.col("start") + LENGTH).alias("end"))


DIGEST = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def _digest_of(hash_only: bool):
    @F.pandas_udf(DIGEST)
    def digest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, spans in zip(texts, found, strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for s in sorted((int(s["start"]), int(s["end"])) for s in (spans if spans is not None else ())):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                parts, at = [], 0
                for start, end in merged:
                    parts.append(raw[at:start])
                    at = end
                kept = b"".join([*parts, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).digest() if hash_only else kept, merged))
            yield pd.DataFrame(out, columns=DIGEST.names)
            release()

    return digest


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept bytes (or their SHA-256) and the removed spans.

    A byte goes if a 400-byte string over it also starts anywhere else, in the same text or another, as the texts were given. Strings do
    not run from one text into the next. A NULL text counts as empty: no bytes, nothing removed. Copies of a row count as texts of
    their own. NULL ids are ids like any other. Bytes, not characters, are cut, so what is kept may begin inside a character.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).alias("text"),
    )
    spans = repeated_spans(keyed).groupBy(F.col("doc").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("start", "end")).alias("found"))
    joined = keyed.join(spans, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    return joined.select(F.col("doc").alias(id_col), _digest_of(hash_only)("text", "found").alias("cut")).select(id_col, "cut.*")


def kept_hash(kept: Column) -> Column:
    return F.lower(F.hex(kept))
