"""Token counts of a byte-level merge vocabulary, by deterministic transducers compiled from its file.

The first transducer parts text into words: its inputs are classes of characters, its outputs say where words begin. Its state maps
(what a stretch of text makes of every state) form a small finite set that is closed under composition, so the maps of all chunks of all texts
are looked up side by side and composed by a prefix scan; only then is it known in which state each chunk begins.

The second one reads a word's bytes, and each transition has the number of tokens it emits: the change in the number of tokens of what has been
read, which can be none or negative where tokens merge. A state has, for each suffix of what has been read that may still grow into a token, the last token before that suffix
and the tokens spent since. Its transitions are compiled when they are first taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from tidemark.llm.common import in_batches, release, worker_state

LIMIT = 512
CHUNK = 64  # characters of a chunk
PIECE = 1 << 19  # characters worked on at a time
MEMO = 1 << 18  # words whose counts a worker remembers
MEMO_CHARS = 64  # the longest of them
STATES = 1 << 18  # compiled states of words; beyond them the compiled part starts anew
LONGEST = 1 << 16  # further states that one long word may make
_NEVER = 1 << 60

# Classes of characters. The letters of contractions stand apart; END comes behind each text.
LETTER, STMD, R, V, L, E, DIGIT, OTHER, QUOTE, SPACE, BLANK, END = range(12)
_LETTERS = (LETTER, STMD, R, V, L, E)
# States: BEGIN is the begin of a word whatever comes; runs of letters, digits and others; one space and one other blank; blanks that end in a space
# and in another; a quote that begins a word, and such a quote with the r, v or l of a contraction behind it.
BEGIN, LETTERS, DIGITS, OTHERS, ONE_SPACE, ONE_BLANK, TO_SPACE, TO_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
HERE, BEFORE = 1, 2  # outputs: a word begins at this character, or at the one before


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs by (state, class) of the transducer that parts text into words.

    Words are contractions ('s 't 'm 'd 're 've 'll), runs of letters, of digits or of others with one space in front, and blanks but the last before
    a word. Blanks and contractions need the next character, so a begin may be told one character late.
    """
    after = np.zeros((12, 12), np.int64)
    said = np.zeros((12, 12), np.uint8)
    run_of = {**dict.fromkeys(_LETTERS, LETTERS), DIGIT: DIGITS, OTHER: OTHERS, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: BEGIN}
    for state in range(12):
        for kind, begun in run_of.items():
            after[state, kind], said[state, kind] = begun, HERE
    continued = {LETTERS: _LETTERS, DIGITS: (DIGIT,), OTHERS: (OTHER, QUOTE), QUOTED: (OTHER, QUOTE)}
    for state, kinds in continued.items():
        for kind in kinds:
            after[state, kind], said[state, kind] = (OTHERS if state == QUOTED else state), 0
    in_front = {**dict.fromkeys(_LETTERS, LETTERS), DIGIT: DIGITS, OTHER: OTHERS, QUOTE: OTHERS}
    for kind, state in in_front.items():  # a space belongs to the word behind it
        after[ONE_SPACE, kind], said[ONE_SPACE, kind] = state, 0
        after[TO_SPACE, kind], said[TO_SPACE, kind] = state, BEFORE
        said[TO_BLANK, kind] |= BEFORE
    for state in (ONE_SPACE, ONE_BLANK, TO_SPACE, TO_BLANK):
        after[state, SPACE], said[state, SPACE] = TO_SPACE, 0
        after[state, BLANK], said[state, BLANK] = TO_BLANK, 0
    after[QUOTED, STMD], said[QUOTED, STMD] = BEGIN, 0
    for kind, state, last in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        after[QUOTED, kind], said[QUOTED, kind] = state, 0
        after[state], said[state] = after[LETTERS], said[LETTERS] | BEFORE  # no contraction after all: the letter began a word
        after[state, last], said[state, last] = BEGIN, 0
    return after, said


def state_maps(after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All state maps that texts have, their products, and the map after one more character of a class. The first is the empty text's."""
    states, kinds = after.shape
    seen = {tuple(range(states)): 0}
    maps = [tuple(range(states))]
    for known in maps:  # grows while it is read
        for kind in range(kinds):
            then = tuple(after[list(known), kind].tolist())
            if then not in seen:
                seen[then] = len(maps)
                maps.append(then)
    if len(maps) > 255:
        raise ValueError("too many state maps for small numbers")
    table = np.array(maps, np.int64)
    products = np.array([[seen[tuple(then)] for then in table[:, first].tolist()] for first in table], np.uint8)
    of_kind = np.array([[seen[tuple(after[first, kind].tolist())] for kind in range(kinds)] for first in table], np.uint8)
    return table.astype(np.uint8), products, of_kind


def character_classes() -> np.ndarray:
    """Class of each code point, by the Unicode tables of the tokenizer library itself; characters newer than those are others there."""
    out = np.full(0x110000, OTHER, np.uint8)
    splits = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    known = regex.compile(r"(?P<letter>\p{L})|(?P<digit>\p{N})|(?P<blank>\s)")
    beside = {"letter": ("a", LETTER), "digit": ("1", DIGIT), "blank": ("\n", BLANK)}
    for code in range(0x110000):
        found = None if 0xD800 <= code < 0xE000 else known.match(chr(code))
        if found:
            same, kind = beside[found.lastgroup]
            if len(splits(same + chr(code))) == 1:
                out[code] = kind
    out[[ord(c) for c in "stmd"]] = STMD
    for c, kind in zip("rvle' ", (R, V, L, E, QUOTE, SPACE), strict=True):
        out[ord(c)] = kind
    return out


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: the bytes of its tokens in order of their merges, the merges as pairs, special strings, and classes of characters."""

    tokens: tuple[bytes, ...]  # 256 bytes first, then one token a merge
    merges: tuple[tuple[int, int], ...]
    special: tuple[str, ...]
    classes: np.ndarray

    @property
    def key(self) -> int:
        return hash((self.tokens, self.merges, self.special))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the rest in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level merge vocabulary (.json) on the driver; it has tens of thousands of tokens whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, parts = given["model"], given.get("pre_tokenizer") or {}
    simple = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    if model.get("type") != "BPE" or not simple or given.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path} is no byte-level merge vocabulary with the usual words")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in given["added_tokens"]):
        raise ValueError("special strings that depend on what stands beside them are not supported")
    letters = _byte_letters()
    tokens = [bytes([b]) for b in range(256)]
    number = {t: i for i, t in enumerate(tokens)}
    merges = []
    for merge in model["merges"]:
        a, b = (bytes(letters[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
        if a + b in number:
            raise ValueError("two merges make one token")
        merges.append((number[a], number[b]))
        number[a + b] = len(tokens)
        tokens.append(a + b)
    special = tuple(sorted((t["content"] for t in given["added_tokens"]), key=len, reverse=True))
    return Vocabulary(tuple(tokens), tuple(merges), special, character_classes())


class WordTransducer:
    """Reads bytes of a word; transitions have the change in the number of tokens, and are compiled when first taken."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.rank = {pair: 256 + i for i, pair in enumerate(vocabulary.merges)}  # a token's number is the rank of the merge that makes it
        self.merge_of = [None] * 256 + list(vocabulary.merges)
        # A trie of the tokens by (node, byte); node 0 is the empty string.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [True]
        for i, token in enumerate(self.tokens):
            node = 0
            for b in token:
                self.inner[node] = True
                then = self.child.get(node << 8 | b)
                if then is None:
                    then = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = then
            self.token_at[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.made: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state is its entries, each a node, a last token and the tokens spent since, packed into one number.
        begin = (self._entry(0, -1, 0),)
        self.number: dict[tuple[int, ...], int] = {begin: 0}
        self.states: list[tuple[int, ...]] = [begin]
        self.step: dict[int, int] = {}  # state << 8 | byte to next state << 10 | tokens emitted + 512

    @staticmethod
    def _entry(node: int, last: int, spent: int) -> int:
        return node << 32 | (last + 1) << 10 | (spent + 512)

    def _edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces at one edge of a token over the merges that make it, each with the rank at which it is merged into the next."""
        out, ends = [], _NEVER
        while True:
            out.append((token, ends))
            if self.merge_of[token] is None:
                return out
            ends, token = token, self.merge_of[token][side]

    def stay_apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge of a rank below ``until`` joins an edge of ``a`` with one of ``b`` while both are there; of equal ranks the left one goes first."""
        for left, left_ends in self._edges(a, 1):
            for right, right_ends in self._edges(b, 0):
                rank = self.rank.get((left, right))
                if rank is not None and rank < until and rank < left_ends and rank <= right_ends:
                    return False
        return True

    def is_made(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes; some tokens are never reached."""
        known = self.made.get(token)
        if known is None:
            merge = self.merge_of[token]
            known = merge is None or (self.is_made(merge[0]) and self.is_made(merge[1]) and self.stay_apart(*merge, token))
            self.made[token] = known
        return known

    def follows(self, last: int, token: int) -> bool:
        """Whether the two stand side by side as they are; -1 is the begin of the word. Side by side all along is enough for a whole word."""
        if last < 0:
            return self.is_made(token)
        known = self.apart.get(last << 20 | token)
        if known is None:
            known = self.apart[last << 20 | token] = self.is_made(token) and self.stay_apart(last, token)
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state by a byte: exactly one of the tokens that end here follows what was before it."""
        grown, token, emitted = [], -1, 0
        for entry in self.states[state]:
            then = self.child.get(entry >> 32 << 8 | byte)
            if then is None:
                continue
            found = self.token_at[then]
            if found >= 0 and token < 0 and self.follows((entry >> 10 & 0x3FFFFF) - 1, found):
                token, emitted = found, (entry & 0x3FF) - 511
            if self.inner[then]:
                grown.append(then << 32 | entry & 0xFFFFFFFF)
        key = (*[entry - emitted for entry in grown], self._entry(0, token, 0))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        found = self.step[state << 8 | byte] = number << 10 | emitted + 512
        return found

    def count(self, word: bytes) -> int:
        """Tokens of a word."""
        if len(self.states) >= STATES:
            self.reset()
            self.apart.clear()
        state = total = 0
        for byte in word:
            found = self.step.get(state << 8 | byte)
            if found is None:
                if len(self.states) >= STATES + LONGEST:  # a word that alone fills the tables: its present state is the only one kept
                    kept = self.states[state]
                    self.reset()
                    state = self.number.setdefault(kept, 1)
                    self.states += [kept][:state]
                found = self.compile(state, byte)
            state = found >> 10
            total += (found & 0x3FF) - 512
        return total


class Counts(dict):
    """Tokens by word, filled as words are asked for."""

    def __init__(self, transducer: WordTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        found = self.transducer.count(word.encode())
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


class Counter:
    """Both transducers of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.classes = vocabulary.classes
        after, self.said = splitter()
        self.maps, self.products, self.of_kind = state_maps(after)
        self.counts = Counts(WordTransducer(vocabulary))
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def word_begins(self, kinds: np.ndarray) -> np.ndarray:
        """Where words begin in a sequence of classes that begins a word itself."""
        n = len(kinds)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, END, np.uint8)
        padded[:n] = kinds
        by_place = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        # Within chunks: the map of each chunk's first characters, all chunks at once.
        grown, kinds_of = self.of_kind.ravel(), np.uint16(self.of_kind.shape[1])
        upto = np.empty((CHUNK, chunks), np.uint8)
        upto[0] = self.of_kind[0][by_place[0]]
        for k in range(1, CHUNK):
            grown.take(upto[k - 1] * kinds_of + by_place[k], out=upto[k], mode="clip")
        # Over chunks: a scan that composes maps over spans of 1, 2, 4 … chunks.
        whole, flat, width = upto[-1].copy(), self.products.ravel(), np.uint16(len(self.products))
        span = 1
        while span < chunks:
            whole[span:] = flat.take(whole[:-span] * width + whole[span:])
            span *= 2
        entered = np.full(chunks, BEGIN, np.uint8)
        entered[1:] = self.maps[whole[:-1], BEGIN]
        state = np.empty((CHUNK, chunks), np.uint8)
        state[0] = entered
        states = np.uint16(self.maps.shape[1])
        self.maps.ravel().take(upto[:-1] * states + entered, out=state[1:], mode="clip")
        said = self.said.ravel().take(state * states + by_place).T.ravel()[:n]
        begins = (said & HERE) > 0
        begins[:-1] |= (said[1:] & BEFORE) > 0
        return begins

    def _of_words(self, text: str, bounds: list[int]) -> np.ndarray:
        counts = self.counts
        return np.fromiter((counts[text[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)), np.int64, len(bounds) - 1)

    def _kinds(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def count_parts(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part, all parts side by side."""
        joined = "\n".join(parts) + "\n"
        kinds = self._kinds(joined)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        begins = np.flatnonzero(self.word_begins(kinds))
        of_word = self._of_words(joined, [*begins.tolist(), len(joined)])
        # What stands behind a text is a word to the transducer; it counts for nothing.
        at_end = np.searchsorted(begins, ends)
        of_word[at_end] = 0
        upto = np.cumsum(of_word)[at_end]
        return np.diff(upto, prepend=0)

    def count_long(self, text: str) -> int:
        """Tokens of a long part, piece by piece; a piece begins where the last word of the one before did."""
        total, begin, size = 0, 0, PIECE
        while begin + size < len(text):
            piece = text[begin: begin + size]
            begins = np.flatnonzero(self.word_begins(self._kinds(piece))).tolist()
            total += int(self._of_words(piece, begins).sum())
            size = PIECE if begins[-1] else 2 * size
            begin += begins[-1]
        return total + int(self.count_parts([text[begin:]])[0])

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; a special string is one."""
        totals = [0] * len(texts)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def settle() -> None:
            for owner, found in zip(owners, self.count_parts(held).tolist() if held else [], strict=True):
                totals[owner] += found
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            totals[i] += len(parts) - 1
            for part in parts:
                if len(part) > PIECE:
                    totals[i] += self.count_long(part)
                elif part:
                    held.append(part)
                    owners.append(i)
                    size += len(part)
                if size >= PIECE:
                    settle()
                    size = 0
        settle()
        return totals


def with_token_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text; a column of that name is replaced.

    NULL and empty texts have none. Special strings in a text are one token each, nothing is added, cut or padded. Repeated rows are rows like others, and an
    empty frame gives an empty frame. No shuffle; the vocabulary is broadcast, and what a worker compiles and remembers is bounded.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.key

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_state(("tokens", key), lambda: Counter(sent.value))
        for texts in batches:
            yield pd.Series(counter.count_texts([t or "" for t in texts.tolist()]), dtype="int64")
            release()

    return in_batches(docs).withColumn(out, count(F.col(text_col)))


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
