"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, release, worker_state

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MEMO = 1 << 16  # parts of words of either generation that a worker remembers, and twice as many words
MEMO_CHARS = 48  # the longest of them
CHUNK = 500  # texts whose ids a worker holds at a time
UNKNOWN_COST = 10.0  # below the worst piece, as the format has it


@dataclass(frozen=True)
class Pieces:
    """A vocabulary read from a model file. Spaces stand as spaces in ``texts``; a text gets one space in front."""

    texts: tuple[str, ...]  # "" for control pieces and bytes
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]  # 256 ids, or none
    unknown_id: int

    @property
    def key(self) -> int:
        return hash((self.texts, self.scores, self.byte_ids))


def read_pieces(path: str = MODEL_PATH) -> Pieces:
    """Read a model file on the driver. A vocabulary has tens of thousands of pieces whatever the corpus."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, scores, byte_of = [], [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        if model.is_byte(i):
            byte_of[int(piece[3:5], 16)] = i
        texts.append("" if special or model.is_byte(i) else piece.replace("▁", " "))
        scores.append(model.get_score(i))
    byte_ids = tuple(byte_of[b] for b in range(256)) if len(byte_of) == 256 else ()
    return Pieces(tuple(texts), tuple(scores), byte_ids, model.unk_id())


class Memo:
    """Ids by text, in two generations: when the young one is full it becomes the old one, and what is still asked for moves on."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def recall(self, text: str) -> tuple[int, ...] | None:
        """From the old generation; the caller has looked in the young one."""
        ids = self.old.get(text)
        return ids if ids is None else self.keep(text, ids)

    def keep(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= MEMO_CHARS:
            if len(self.young) >= self.most:
                self.old = self.young.copy()
                self.young.clear()
            self.young[text] = ids
        return ids


class Coder:
    """Automaton and memo of one worker."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.unknown = min((s for t, s in zip(pieces.texts, pieces.scores, strict=True) if t), default=0.0) - UNKNOWN_COST
        # Pieces as (length, id, score). Those of one character need no automaton; a character that is none is ``alone``.
        self.alone = (1, -1, self.unknown)
        self.single: dict[str, tuple[int, int, float]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, (text, score) in enumerate(zip(pieces.texts, pieces.scores, strict=True)):
            if len(text) == 1:
                self.single.setdefault(text, (1, i, score))
            elif text and text not in self.automaton:
                self.automaton.add_word(text, (len(text), i, score))
        self.longer = len(self.automaton) > 0
        if self.longer:
            self.automaton.make_automaton()
        # No piece lies over a pair of characters that no piece holds, so best paths of the parts on either side make the best path.
        self.pairs = {t[i: i + 2] for t in pieces.texts for i in range(len(t) - 1)}
        self.by_space = not any(pair[1] == " " != pair[0] for pair in self.pairs)
        self.words, self.parts = Memo(2 * MEMO), Memo(MEMO)
        as_bytes = [t.encode() for t in pieces.texts]
        for value, i in enumerate(pieces.byte_ids):
            as_bytes[i] = bytes([value])
        if not as_bytes[pieces.unknown_id]:
            as_bytes[pieces.unknown_id] = "�".encode()
        self.as_bytes = as_bytes

    def best_path(self, part: str) -> tuple[int, ...]:
        """Ids of the path of pieces with the greatest sum of scores; among equals the longer last piece wins.

        The automaton yields, at each position, every piece that ends there (it follows the output links); each relaxes
        the best score of its end from that of its start, which is final by then. A character on its own costs more than any
        piece and is what ends where nothing else does; it is written as its bytes.
        """
        n = len(part)
        best = [0.0] * (n + 1)
        back: list[tuple[int, int, float]] = [self.alone] * (n + 1)
        single, alone, filled = self.single, self.alone, 0
        for last, piece in self.automaton.iter(part) if self.longer else ():
            # Up to here every end has its single character; longer pieces come in order of their ends.
            while filled <= last:
                back[filled + 1] = one = single.get(part[filled], alone)
                best[filled + 1] = best[filled] + one[2]
                filled += 1
            total = best[filled - piece[0]] + piece[2]
            if total > best[filled] or (total == best[filled] and piece[0] > back[filled][0]):
                best[filled], back[filled] = total, piece
        while filled < n:
            back[filled + 1] = one = single.get(part[filled], alone)
            best[filled + 1] = best[filled] + one[2]
            filled += 1
        out: list[int] = []
        end = n
        while end:
            length, i, _ = back[end]
            if i >= 0:
                out.append(i)
            elif self.pieces.byte_ids:
                out += [self.pieces.byte_ids[b] for b in reversed(part[end - 1].encode())]
            else:
                out.append(self.pieces.unknown_id)
            end -= length
        out.reverse()
        return tuple(out)

    def _path(self, text: str) -> list[int]:
        """Best path of a text, part by part."""
        out: list[int] = []
        begin, pairs, parts = 0, self.pairs, self.parts
        cuts = [i for i in range(1, len(text)) if text[i - 1: i + 1] not in pairs]
        for end in (*cuts, len(text)):
            part = text[begin:end]
            out += parts.young.get(part) or parts.recall(part) or parts.keep(part, self.best_path(part))
            begin = end
        return out

    def encode(self, text: str | None) -> np.ndarray | None:
        """Ids of a text; words between single spaces are looked up whole."""
        if text is None:
            return None
        out: list[int] = []
        if not text or not self.by_space or "  " in text or text[0] == " " or text[-1] == " ":
            return np.array(self._path(" " + text) if text else out, dtype=np.int32)
        words, known = self.words, self.words.young.get
        for word in text.split(" "):
            out += known(word) or words.recall(word) or words.keep(word, tuple(self._path(" " + word)))
        return np.array(out, dtype=np.int32)

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        return b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _coder(key: int, sent) -> Coder:
    return worker_state(("pieces", key), lambda: Coder(sent.value))


def _chunks(batches: Iterator[pd.Series]) -> Iterator[list]:
    for batch in batches:
        for k in range(0, len(batch), CHUNK):
            yield batch.iloc[k: k + CHUNK].tolist()
        release()


IDS = T.ArrayType(T.IntegerType())
CODED = T.StructType([T.StructField("ids", IDS), T.StructField("same", T.BooleanType())])


def with_pieces(docs: DataFrame, pieces: Pieces, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text; a column of that name is replaced.

    NULL gives NULL, an empty text no ids. Every text decodes to itself: characters without a piece go as their bytes, and text is not
    normalised. No shuffle; the vocabulary is broadcast.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(pieces), pieces.key

    @F.pandas_udf(IDS)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(key, sent)
        for texts in _chunks(batches):
            yield pd.Series([coder.encode(t) for t in texts], dtype=object)

    return in_batches(docs).withColumn(out, encode(F.col(text_col)))


def with_text(coded: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each list of ids, NULL for NULL; a column of that name is replaced. The space that encoding put in front goes."""
    sent, key = coded.sparkSession.sparkContext.broadcast(pieces), pieces.key

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(key, sent)
        for lists in _chunks(batches):
            yield pd.Series([coder.decode(ids) for ids in lists], dtype=object)

    return in_batches(coded).withColumn(out, decode(F.col(ids_col)))


def with_checked_pieces(docs: DataFrame, pieces: Pieces, text_col: str = "text", out: str = "coded") -> DataFrame:
    """Add a struct of the ids of each whole text and whether they decode to it, worked out side by side; NULL ids decode to NULL."""
    sent, key = docs.sparkSession.sparkContext.broadcast(pieces), pieces.key

    @F.pandas_udf(CODED)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(key, sent)
        for texts in _chunks(batches):
            ids = [coder.encode(t) for t in texts]
            same = [coder.decode(None if i is None else i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": same})

    return in_batches(docs).withColumn(out, code(F.col(text_col)))


def n_pieces(ids: Column) -> Column:
    return F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0)).cast("long")
