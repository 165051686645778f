"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import held_out, in_batches, release, worker_state

# Bounds of what is learned: passages a language, characters a passage.
PASSAGES = 64
PASSAGE_CHARS = 512
CLASSES = 64  # classes of a language in the dense table; all other characters of its sample have sorted transitions
MOST_LANGUAGES = 256
UNKNOWN = "und"


def folded(text: str) -> np.ndarray:
    """Code points of a text, lower case, every non-letter a space."""
    lower = text.lower()
    return np.frombuffer(lower.encode("utf-32-le"), dtype=np.uint32)


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    out = np.zeros(0x110000, dtype=bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


def _edges(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the smallest automaton of all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


def suffix_automaton(codes: list[int], classes: int) -> np.ndarray:
    """Transitions of the smallest automaton of all substrings as a table, -1 where there is none."""
    edges = _edges(codes)
    table = np.full((len(edges), classes), -1, dtype=np.int32)
    for state, out in enumerate(edges):
        if out:
            table[state, list(out)] = list(out.values())
    return table


@dataclass
class LanguageModel:
    """Sample text of each language; the automata are built where they are used, once a worker."""

    texts: dict[str, str]
    classes: int = CLASSES
    _built: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"texts": self.texts, "classes": self.classes, "_built": None}

    @property
    def key(self) -> int:
        return zlib.crc32(repr((sorted(self.texts.items()), self.classes)).encode())

    def build(self) -> tuple:
        """Character numbers, letters, and one parser for all languages: starts, names and sample sizes beside it.

        A number stands for a character that some sample has, 0 for all others. Each language has classes of its own: 0 for
        what its sample lacks, then its characters by falling frequency. A cell of the table holds 2 * next state + 1 if the
        character starts a new phrase: the longest match ends before it, and matching goes on from the start of the
        language's automaton. The table has the first ``classes`` classes of a language; transitions by its other characters
        are sorted keys. A character a sample does not have is a phrase of its own.
        """
        if self._built is not None:
            return self._built
        letters = _letters()
        plain = {lang: np.where(letters[codes := folded(text)], codes, 32) for lang, text in sorted(self.texts.items())}
        known = np.unique(np.concatenate([*plain.values(), [32]])).astype(np.int64)
        to_class = np.zeros(0x110000, dtype=np.uint16 if len(known) < 1 << 16 else np.int32)
        to_class[known] = np.arange(1, len(known) + 1)
        to_class[~letters] = to_class[32]
        classes_of = np.zeros((len(plain), len(known) + 1), dtype=np.int32)
        tables, starts, sizes, base, width = [], [], [], 0, len(known) + 1
        keys, values, anew_of = [], [], np.zeros((len(plain), width), dtype=np.int32)
        for i, lang in enumerate(plain):
            numbers = to_class[plain[lang]]
            own, counts = np.unique(numbers, return_counts=True)
            classes_of[i, own[np.lexsort((own, -counts))]] = np.arange(1, len(own) + 1)
            edges = _edges(classes_of[i, numbers].tolist())
            # The last row is where a text starts, and where it is after a character the sample does not have.
            table = np.full((len(edges) + 1, self.classes), -1, dtype=np.int32)
            for state, out in enumerate(edges):
                for c, to in out.items():
                    if c < self.classes:
                        table[state, c] = to
                    else:
                        keys.append((state + base) * width + c)
                        values.append(to + base)
            anew = np.where(table[0] >= 0, table[0], len(table) - 1)
            tables.append(np.where(table >= 0, 2 * (table + base), 2 * (anew[None, :] + base) + 1).astype(np.int32))
            for c, to in edges[0].items():
                anew_of[i, c] = to + base
            starts.append(base + len(table) - 1)
            sizes.append(max(2, len(numbers)))
            base += len(table)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        order = np.argsort(keys)
        parser = (np.concatenate(tables).ravel(), classes_of, np.append(keys[order], -1), np.append(values[order], 0), anew_of)
        self._built = (to_class, letters, parser, np.array(starts, np.int32), list(plain), np.array(sizes, float))
        return self._built

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text in each language, its length, and whether it has a letter; all texts step side by side."""
        to_class, letters, (table, classes_of, keys, values, anew_of), starts, langs, _ = self.build()
        n, width, sparse = len(texts), classes_of.shape[1], len(keys) > 1
        counts = np.zeros((len(langs), n), dtype=np.int64)
        lengths = np.zeros(n, dtype=np.int64)
        lettered = np.zeros(n, dtype=bool)
        coded = []
        for i, text in enumerate(texts):
            codes = folded(text) if text else np.empty(0, np.uint32)
            lengths[i] = len(codes)
            lettered[i] = bool(len(codes)) and bool(letters[codes].any())
            coded.append(to_class[codes])
        order = np.argsort(-lengths, kind="stable")
        if not n or not lengths[order[0]]:
            return counts, lengths, lettered
        flat = np.concatenate([coded[i] for i in order])
        sorted_lengths = lengths[order]
        offsets = np.concatenate([[0], np.cumsum(sorted_lengths)[:-1]])
        states = np.repeat(starts[:, None], n, axis=1).astype(np.int32)
        found = np.zeros((len(langs), n), dtype=np.int64)
        active = n
        for t in range(int(sorted_lengths[0])):
            while sorted_lengths[active - 1] <= t:
                active -= 1
            own = classes_of[:, flat[offsets[:active] + t]]
            if sparse and (rare := own >= self.classes).any():
                lang, at = np.nonzero(rare)
                c = own[lang, at]
                own[lang, at] = 0
                cells = table[states[:, :active] * self.classes + own]
                wanted = states[lang, at] * np.int64(width) + c
                place = np.searchsorted(keys[:-1], wanted)
                cells[lang, at] = np.where(keys[place] == wanted, 2 * values[place], 2 * anew_of[lang, c] + 1)
            else:
                cells = table[states[:, :active] * self.classes + own]
            found[:, :active] += cells & 1
            states[:, :active] = cells >> 1
        counts[:, order] = found
        return counts, lengths, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score in 0 to 1 and bits a character of each text.

        A phrase costs as many bits as a place in the language's sample does; the language that needs the fewest bits a
        character wins, the first by name among equals. The score is the winner's lead over the next, as a share of the next's.
        """
        if not self.texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        counts, lengths, lettered = self.phrases(texts)
        *_, langs, sizes = self.build()
        bits = counts * np.log2(sizes)[:, None] / np.maximum(lengths, 1)
        best = np.argmin(bits, axis=0)
        ordered = np.sort(bits, axis=0)
        second = ordered[1] if len(langs) > 1 else np.full(len(texts), math.inf)
        lead = 1.0 - ordered[0] / np.where(second > 0, second, 1.0)
        return (
            [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)],
            np.where(lettered, np.clip(lead, 0.0, 1.0), 0.0).tolist(),
            np.where(lettered, ordered[0], 0.0).tolist(),
        )


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows that a model may learn from: all but those held out."""
    return docs.where(~held_out(F.col(id_col)))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> LanguageModel:
    """Sample text of each language from labelled rows with text and language.

    At most ``passages`` passages of ``chars`` characters a language are drawn, by the hash of the id and of the text; each is
    a stretch from anywhere in its text. This bounded sample is all the driver sees. More than 256 languages are refused.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    draw = F.xxhash64(F.col(id_col), F.lit("passage"), F.length(text_col))
    at = F.pmod(F.xxhash64(F.lit("start"), F.col(id_col)), F.greatest(F.length(text_col) - chars, F.lit(1))) + 1
    ranked = known.select(
        F.col(lang_col).cast("string").alias("lang"), draw.alias("draw"),
        F.col(text_col).substr(at.cast("int"), F.lit(chars)).alias("passage"),
    )
    first = Window.partitionBy("lang").orderBy("draw", "passage")
    chosen = ranked.withColumn("n", F.row_number().over(first)).where(F.col("n") <= passages)
    rows = chosen.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "passage"))).alias("passages")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return LanguageModel({r.lang: " ".join(p.passage for p in r.passages) for r in rows})


RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_char", T.DoubleType()),
])


def _model(key: int, sent) -> LanguageModel:
    """The model of this worker, a copy of its own, so that its tables go with it."""
    return worker_state(("language model", key), lambda: LanguageModel(sent.value.texts, sent.value.classes))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add a struct column (lang_pred, score, bits_per_char) to every row; whole texts are parsed.

    NULL and letterless texts, and every text under a model of no language, get ``und`` and score 0. Equal texts get equal
    results. A column named as ``out`` is replaced, others stay. The model's sample (64 KB a language at most) travels
    with the task; there is no shuffle.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    @F.pandas_udf(RESULT)
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(key, sent)
        for texts in batches:
            yield pd.DataFrame(dict(zip(RESULT.names, model.predict(texts.tolist()), strict=True)), columns=RESULT.names)
            release()

    return in_batches(docs).withColumn(out, language(F.col(text_col)))
