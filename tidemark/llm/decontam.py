"""Benchmark decontamination by template canonicalisation: typed placeholders, hash-joined windows, consistent slots."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, in_batches, release, worker_state

WINDOW = 8  # template words a window
LEAST_WORDS = 4  # plain words a window needs; fewer cannot tell a passage from ordinary text
COVERAGE = 0.5  # share of an item's words in matched windows
RUN_WORDS = 20  # words of an item in a row, in matched windows of one copy, that count whatever share of the item they are
FILTER_BITS = (20, 28)  # least and most bits of the filter, as powers of two
BITS_EACH = 32  # bits of the filter for each window of the benchmark
CHUNK = 1 << 20  # characters of texts that are worked on side by side

# Measure words that count as units behind a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres s sec"
    " second seconds min minute minutes h hr hour hours day days week weeks month months year years percent usd eur dollar"
    " dollars euro euros cent cents degree degrees mph kmh hz khz mhz ghz w kw kwh v volt volts a amp amps j joule joules n".split()
)
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
WORDS, BOTH, TEMPLATE, MARKED = 0, 1, 2, 3  # forms of a window; MARKED is a template whose first word is taken as a name
_MARK = {NUMBER: "\x01number", NAME: "\x01name", UNIT: "\x01unit"}
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,]*%?\Z")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-z]+)\Z")
_EDGE = " \t.,;:!?\"'()[]{}<>«»“”‘’…*|_`"
_HASH = {kind: xxhash.xxh3_64_intdigest(text) for kind, text in _MARK.items()}
_ODD = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)]
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse among 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE, EDGE, DIGIT, UPPER, LOWER, TITLE, STOP = (1 << k for k in range(7))


def _mixed(sums: np.ndarray) -> np.ndarray:
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    sums ^= sums >> np.uint64(32)
    return sums


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """What each code point is, and its lower-case form."""
    flags, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        small = c.lower()
        if len(small) == 1:
            lower[code] = ord(small)
        flags[code] = SPACE * c.isspace() | DIGIT * c.isdecimal() | UPPER * c.isupper() | LOWER * c.islower() | TITLE * (c.istitle() and not c.isupper())
    for marked, flag in ((_EDGE, EDGE), (".!?:", STOP)):
        flags[[ord(c) for c in marked]] |= flag
    return flags, lower


def _unit_hashes(parser: Parser) -> np.ndarray:
    return np.sort(parser.words([" ".join(sorted(UNITS))]).hash)


@dataclass
class Parsed:
    """Words of texts laid end to end: where each stands, the text it is of, its kind, its hash, and whether it would be a name inside a sentence."""

    joined: str
    first: np.ndarray
    stop: np.ndarray
    owner: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    capital: np.ndarray

    def lower(self, i: int) -> str:
        return self.joined[self.first[i]: self.stop[i]].lower()


class Parser:
    """Reads words of many texts side by side. A word's hash is that of its lower-case characters, from sums over all characters up to its ends."""

    def __init__(self):
        self.flags, self.small = _characters()
        self.power = self.back = np.ones(1, np.uint64)
        self.units = None
        self.units = _unit_hashes(self)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("back", _INVERSE)):
                steps = np.full(n, np.uint64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, texts: list[str]) -> Parsed:
        """Bare words; those of punctuation alone are left out, after what they say of the word behind them.

        A number (with sign, currency, per cent or a unit written to it) is of kind NUMBER, a unit word behind a number UNIT, a
        capitalised word inside a sentence NAME.
        """
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        flags = self.flags[codes]
        gap = (flags & SPACE) > 0
        turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        bounds = turn if gap[0] else np.concatenate([[0], turn])
        raw_first, raw_stop = bounds[0::2], bounds[1::2]  # the last character is a gap
        # Bare ends by the places that are no edge; prefix counts tell how many lie before.
        inner = np.flatnonzero((flags & (EDGE | SPACE)) == 0)
        before = np.searchsorted(inner, raw_first)
        upto = np.searchsorted(inner, raw_stop)
        empty = before == upto
        stops = (flags[raw_stop - 1] & STOP) > 0
        keep = ~empty | stops
        raw_first, before, upto, empty, stops = raw_first[keep], before[keep], upto[keep], empty[keep], stops[keep]
        places = np.append(inner, 0)
        first = np.where(empty, raw_first, places[before])
        stop = np.where(empty, raw_first, places[upto - 1] + 1)
        sizes = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(sizes, first, side="right")
        self._powers(len(codes))
        values = _mixed((self.small[codes].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.power[: len(codes)])])
        hashes = _mixed((sums[stop] - sums[first]) * self.back[first] + (stop - first).astype(np.uint64))

        def some(flag: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """How many characters between a and b have the flag."""
            of = np.flatnonzero((flags & flag) > 0)
            return np.searchsorted(of, b) - np.searchsorted(of, a)

        rest = np.minimum(first + 1, stop)
        capital = ~empty & ((flags[np.minimum(first, len(flags) - 1)] & UPPER) > 0) & (some(LOWER, rest, stop) > 0) & (some(UPPER | TITLE, rest, stop) == 0)
        kind = np.zeros(len(first), np.int8)
        for i in np.flatnonzero(some(DIGIT, first, stop) > 0).tolist():
            word = joined[first[i]: stop[i]].lower()
            if _NUMBER.match(word) or ((m := _NUMBER_UNIT.match(word)) and m[2] in UNITS):
                kind[i] = NUMBER
        begins = np.ones(len(first), bool)
        begins[1:] = (owner[1:] != owner[:-1]) | stops[:-1]
        kind[capital & ~begins & (kind == PLAIN)] = NAME
        if self.units is not None:
            behind = np.zeros(len(first), bool)
            behind[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
            behind = np.flatnonzero(behind & (kind == PLAIN))
            near = np.minimum(np.searchsorted(self.units, hashes[behind]), len(self.units) - 1)
            kind[behind[self.units[near] == hashes[behind]]] = UNIT
        keep = ~empty
        return Parsed(joined, first[keep], stop[keep], owner[keep], kind[keep], hashes[keep], capital[keep])


def parser() -> Parser:
    """The worker's parser; its tables of characters are the same for every use."""
    global _PARSER
    if _PARSER is None:
        _PARSER = Parser()
    return _PARSER


_PARSER: Parser | None = None


def template(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Bare words of a text, their kinds and their template hashes.

    A number (with sign, currency, per cent or a unit written to it) becomes a number placeholder, a unit word behind a
    number a unit placeholder, a capitalised word inside a sentence a name placeholder. Words that are only punctuation go.
    """
    words, kind, hashes, _ = _hashed(text)
    return words, kind, hashes[1]


def _hashed(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """Bare words, kinds, hashes of the words as they are and of the template, and whether the first word would be a name inside a sentence."""
    parsed = parser().words([text or ""])
    hashes = np.stack([parsed.hash, parsed.hash])
    for k, value in _HASH.items():
        hashes[1, parsed.kind == k] = value
    name = bool(len(parsed.kind)) and bool(parsed.capital[0]) and parsed.kind[0] == PLAIN
    return [parsed.lower(i) for i in range(len(parsed.kind))], parsed.kind, hashes, name


def windows(kind: np.ndarray, hashes: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and forms of the windows: each window's words as they are, and its template.

    A template stands beside the words where it has a placeholder and enough plain words; without a placeholder it is the
    same as the words, which are of form BOTH then.
    """
    n = hashes.shape[1] - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    out = np.full((2, n), np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64)))
    for k in range(width):
        out += hashes[:, k:k + n] * np.uint64(_ODD[k])
    upto = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    plain = upto[width:] - upto[:-width]
    out = _mixed(out)
    row, at = np.nonzero(np.stack([np.ones(n, bool), (plain >= min(LEAST_WORDS, width)) & (plain < width)]))
    form = np.where(row > 0, TEMPLATE, np.where(plain[at] == width, BOTH, WORDS))
    return at, out[row, at].view(np.int64), form


def _slots(words: list[str], kind: np.ndarray, at: int, width: int) -> list[str]:
    """Values of the placeholders in a window, each as its place in the window, kind and word."""
    return [f"{k}\x1f{kind[at + k]}\x1f{words[at + k]}" for k in range(width) if kind[at + k] != PLAIN]


WINDOWS = "width int, at int, hash long, form int, slots array<string>"


def _keyed(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def _item_windows(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Windows of each item's whole text: of WINDOW words, or of all words where an item has fewer but at least ``least``.

    A first word that may be a name is taken as one too, since the text before it in a document decides that there.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("of", "width", "at", "hash", "form", "slots", "words")}
            for i, text in enumerate(batch["text"].to_pylist()):
                words, kind, hashes, name = _hashed(text)
                width = min(WINDOW, len(words))
                if width < min(least, WINDOW):
                    continue
                at, found, form = windows(kind, hashes, width)
                made = [(a, h, f, kind) for a, h, f in zip(at.tolist(), found.tolist(), form.tolist(), strict=True)]
                if name:
                    inside = np.concatenate([[np.int8(NAME)], kind[1:width]])
                    marked = np.concatenate([[np.uint64(_HASH[NAME])], hashes[1, 1:width]])
                    _, also, forms = windows(inside, np.stack([hashes[0, :width], marked]), width)
                    made += [(0, h, MARKED, inside) for h, f in zip(also.tolist(), forms.tolist(), strict=True) if f == TEMPLATE]
                for a, h, f, kinds in made:
                    # Words as they are: the item's side says where its slots are, whatever they look like in the document.
                    for key, value in zip(out, (i, width, a, h, f, _slots(words, kinds, a, width), len(words)), strict=True):
                        out[key].append(value)
            yield _batch_of(batch, keys, out)

    return rows.select(*keys, "text").mapInArrow(make, f"{_keyed(rows, keys)}, {WINDOWS}, words int")


def _batch_of(batch: pa.RecordBatch, keys: list[str], out: dict[str, list]) -> pa.RecordBatch:
    pick = pa.array(out.pop("of"), pa.int32())
    kinds = {"hash": pa.int64(), "slots": pa.list_(pa.string())}
    columns = {k: batch[k].take(pick) for k in keys} | {name: pa.array(values, kinds.get(name, pa.int32())) for name, values in out.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class Finder:
    """Windows of documents that a filter of the benchmark's windows lets pass."""

    def __init__(self, bits: np.ndarray, widths: list[int]):
        self.bits, self.widths = bits, widths
        self.cells = np.uint64(len(bits) * 8 - 1)
        self.of_mark = np.array([0, *[_HASH[k] for k in (NUMBER, NAME, UNIT)]], np.uint64)

    def _passed(self, sums: np.ndarray) -> np.ndarray:
        cell = sums & self.cells
        return (self.bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, list[str]]]:
        """Text, width, place, hash, form and slots of each window that passes. All texts are worked on side by side."""
        parsed = parser().words(texts)
        kind, owner, literal = parsed.kind, parsed.owner, parsed.hash
        typed = np.where(kind == PLAIN, literal, self.of_mark[kind])
        upto = np.concatenate([[0], np.cumsum(kind == PLAIN)])
        first = np.searchsorted(owner, np.arange(len(texts)))
        for width in self.widths:
            n = len(kind) - width + 1
            if n <= 0:
                continue
            whole = owner[width - 1:] == owner[:n]
            plain = upto[width:] - upto[:-width]
            sums = np.full(n, np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64)))
            for k in range(width):
                sums += literal[k:k + n] * np.uint64(_ODD[k])
            sums = _mixed(sums)
            at = np.flatnonzero(self._passed(sums) & whole)
            for i, h, p in zip(at.tolist(), sums[at].view(np.int64).tolist(), plain[at].tolist(), strict=True):
                yield int(owner[i]), width, i - int(first[owner[i]]), h, BOTH if p == width else WORDS, []
            # A template differs from the words only where a placeholder stands.
            at = np.flatnonzero(whole & (plain >= min(LEAST_WORDS, width)) & (plain < width))
            sums = np.full(len(at), np.uint64(width * 0x9E3779B97F4A7C15 % (1 << 64)))
            for k in range(width):
                sums += typed[at + k] * np.uint64(_ODD[k])
            sums = _mixed(sums)
            hit = self._passed(sums)
            for i, h in zip(at[hit].tolist(), sums[hit].view(np.int64).tolist(), strict=True):
                words = [parsed.lower(j) for j in range(i, i + width)]
                yield int(owner[i]), width, i - int(first[owner[i]]), h, TEMPLATE, _slots(words, kind[i:i + width], 0, width)


def _document_windows(rows: DataFrame, keys: list[str], wanted) -> DataFrame:
    """Windows of each row's whole text that pass the filter; ``wanted`` is a broadcast pair of its bits and the widths to look for."""
    state = ("windows", uuid.uuid4().hex)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_state(state, lambda: Finder(*wanted.value))
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("of", "width", "at", "hash", "form", "slots")}
            texts = [t or "" for t in batch["text"].to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                for i, *found in finder.find(texts[begin:end]):
                    for key, value in zip(out, (begin + i, *found), strict=True):
                        out[key].append(value)
                begin = end
            yield _batch_of(batch, keys, out)
            release()

    return in_batches(rows).select(*keys, "text").mapInArrow(make, f"{_keyed(rows, keys)}, {WINDOWS}")


def _filter_bits(items: DataFrame) -> np.ndarray:
    """A bit for each window hash of the benchmark, in a table that fits their number."""
    total = max(items.count(), 1)
    power = min(max((total * BITS_EACH - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    cell = F.col("hash").bitwiseAND((1 << power) - 1) + 1
    rows = items.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    out = np.zeros((1 << power) // 8, np.uint8)
    for r in rows:
        begin = (r.bucket - 1) * 4096
        out[begin: begin + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _longest_run(places: Column, width: Column) -> Column:
    """Words of the longest stretch that windows at these places, in order, cover without a gap."""
    none = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"), F.lit(0).alias("best"))

    def step(s: Column, p: Column) -> Column:
        start, end = F.when(p <= s["end"], s["start"]).otherwise(p), p + width
        return F.struct(start.alias("start"), end.alias("end"), F.greatest(s["best"], end - start).alias("best"))

    return F.aggregate(places, none, step, lambda s: s["best"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    coverage: float = COVERAGE, run_words: int = RUN_WORDS,
) -> DataFrame:
    """Benchmark items that documents hold, verbatim or with other numbers, names and units.

    One row per (id, item) with the share of the item's words in matched windows, the first matched word
    of the document, and ``kind``: ``verbatim`` if all slots of some copy are equal, ``reworded`` if slots differ but each value of the
    item stands for one value throughout the copy. Copies whose slots contradict each other do not count. A
    pair counts by half of the item's words, or by 20 of them in a row in one copy, however long the item is. A window
    matches by its words in any case, or by its template if that has 4 plain words. Where templates alone make a pair count, the
    figures are theirs. Items of fewer than 8 words are
    looked up whole; those of fewer than 4 words, and NULL or empty texts on either side, match nothing. NULL ids are ids like any other; repeated rows give the same finding once. Other columns are left out.

    Every window of every whole text is tested against a filter of the benchmark's windows, 32 bits for each and 32 MB at most;
    only windows that pass it move, to an exact join by hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    items = cut(_item_windows(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), ["item"], LEAST_WORDS))
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    wanted = spark.sparkContext.broadcast((_filter_bits(items), widths))
    found = _document_windows(rows, ["doc"], wanted)
    of_item = items.select(F.col("item"), F.col("width").alias("w"), F.col("at").alias("item_at"), F.col("hash").alias("h"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots"), "words").distinct()
    typed = F.col("form") >= TEMPLATE
    alike = (typed == (F.col("item_form") >= TEMPLATE)) & (~typed | (F.size("slots") == F.size("item_slots")))
    met = found.join(of_item, (F.col("hash") == F.col("h")) & (F.col("width") == F.col("w")) & alike)
    # Where the words are equal, the document's slots are the item's.
    met = met.withColumn("slots", F.when(typed, F.col("slots")).otherwise(F.col("item_slots")))
    # Pairs are judged by their template windows alone (rule 0) and by all windows together (rule 1).
    by_template = (F.col("form") == F.col("item_form")) & (F.col("form") != WORDS)
    met = met.withColumn("rule", F.explode(F.when(by_template, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    # Placeholders must stand at the same places and be of one kind; the hash says so, this makes sure.
    place = lambda s: F.substring_index(s, "\x1f", 2)
    value = lambda s: F.substring_index(s, "\x1f", -1)
    kind = lambda s: F.substring_index(F.substring_index(s, "\x1f", 2), "\x1f", -1)
    met = met.withColumn("pairs", pairs).where(F.forall("pairs", lambda p: place(p["item"]) == place(p["doc"])))
    slots = F.transform("pairs", lambda p: F.struct(kind(p["item"]).alias("kind"), value(p["item"]).alias("item"), value(p["doc"]).alias("doc")))
    # Windows at one distance from the item's are one copy of it; its slots must agree with each other.
    copies = met.groupBy("doc", "item", "rule", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("places"), F.min("at").alias("first_word"), F.max("words").alias("words"), F.max("width").alias("width"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"),
    )
    sources = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"]))))
    verbatim = F.forall("slots", lambda s: s["item"] == s["doc"])
    copies = copies.withColumn("kind", F.when(verbatim, "verbatim").when(sources == F.size("slots"), "reworded")).where("kind IS NOT NULL")
    copies = copies.withColumn("run", _longest_run(F.sort_array("places"), F.col("width")))
    by_pair = copies.groupBy("doc", "item", "rule").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.min("first_word").alias("first_word"), F.max("words").alias("words"),
        F.max("width").alias("width"), F.max("kind").alias("kind"), F.max("run").alias("run"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    judged = by_pair.withColumn("coverage", covered / F.col("words")).where((F.col("coverage") >= coverage) | (F.col("run") >= run_words))
    best = judged.groupBy("doc", "item").agg(F.min(F.struct("rule", "coverage", "first_word", "kind")).alias("best"))
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "best.coverage", F.col("best.first_word").cast("long").alias("first_word"), "best.kind",
    )


def remove_leaks(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` without those whose id has a leak; all columns stay."""
    bad = leaks.select(F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
