"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_batches, release

SAMPLE = 6000  # labelled documents learned from
SAMPLE_LINES = 200  # documents with more lines are not learned from
BINS = 8
STEPS = 300
RATE = 0.05
PENALTY = 1e-3

FEATURES = (
    "words", "word length", "capitals", "symbols", "digits", "words like the one before", "distinct words", "seen line", "sentence ends", "commas",
    "short words", "capitalised words", "new words", "capital words",
)
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_ENDS, _COMMAS = b".!?", b",;:"
_SYMBOLS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?")


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each line of a text, and the lines' lengths; an empty text is one empty line."""
    lines = (text or "").split("\n")
    out = np.zeros((len(lines), len(FEATURES)), np.float32)
    sizes = np.empty(len(lines), np.float64)
    seen_lines: set[int] = set()
    seen_words: set[int] = set()
    for i, line in enumerate(lines):
        raw = line.encode()
        size = len(raw)
        sizes[i] = max(1, len(line))
        words = line.split()
        n = len(words)
        if n:
            distinct = set(map(hash, words))
            mark = hash(line)
            without = size - len(raw.translate(None, _SYMBOLS))
            out[i] = (
                n, len(line) / n, (size - len(raw.translate(None, _UPPER))) / size, without / size, (size - len(raw.translate(None, _DIGITS))) / size,
                sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(distinct) / n, mark in seen_lines,
                (size - len(raw.translate(None, _ENDS))) / n, (size - len(raw.translate(None, _COMMAS))) / n,
                sum(len(w) < 4 for w in words) / n, sum(w[0].isupper() for w in words) / n, len(distinct - seen_words) / n, sum(map(str.isupper, words)) / n,
            )
            seen_lines.add(mark)
            seen_words |= distinct
    return out, sizes


def _spread(bins: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cells of the weight table that each line uses: its own bins, those of the line before and of the line after."""
    n, k = bins.shape
    own = bins + np.arange(k) * (BINS + 1)
    none = np.full(k, BINS) + np.arange(k) * (BINS + 1)
    before = np.vstack([none[None, :], own[:-1]]) if n else own
    after = np.vstack([own[1:], none[None, :]]) if n else own
    before[starts] = none
    after[ends] = none
    table = k * (BINS + 1)
    return np.hstack([own, before + table, after + 2 * table])


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the documents from the longest, where each begins, and how many have a line at each step."""
    order = np.argsort(-lengths, kind="stable")
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return order, begins, active


def _passed(message: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds of good that a state's log odds carry over a transition with scores t[from, to]."""
    return np.logaddexp(t[0, 1], message + t[1, 1]) - np.logaddexp(t[0, 0], message + t[1, 0])


def marginals(odds: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents side by side.

    ``odds`` are the lines' own log odds of good, documents one after another. Returns log odds from the lines up to each line, those
    from the lines after it, and their sum, the log odds of the line's marginal.
    """
    order, begins, active = _steps(lengths)
    forward, backward = odds.copy(), np.zeros_like(odds)
    for step in range(1, len(active)):
        at = begins[: active[step]] + step
        forward[at] += _passed(forward[at - 1], t)
    for step in range(len(active) - 1, 0, -1):
        at = begins[: active[step]] + step
        backward[at - 1] = _passed(odds[at] + backward[at], t.T)
    return forward, backward, forward + backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class LineField:
    """Bin edges, weights of bins (own, line before, line after), a bias, and transition scores."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    scale: float
    shift: float

    @property
    def key(self) -> int:
        return zlib.crc32(self.edges.tobytes() + self.weights.tobytes() + self.transitions.tobytes() + np.array([self.bias, self.scale, self.shift]).tobytes())

    def bins(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], measures[:, k], side="right") for k in range(measures.shape[1])], axis=1)

    def line_odds(self, measures: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log odds of the marginal of each line."""
        ends = np.cumsum(lengths) - 1
        cells = _spread(self.bins(measures), ends - lengths + 1, ends)
        return marginals(self.weights[cells].sum(axis=1) + self.bias, lengths, self.transitions)[2]

    def scores(self, texts: list[str | None]) -> list[float]:
        """Length-weighted mean of the lines' marginals, brought to the scale of document labels."""
        if not texts:
            return []
        parts = [line_features(t) for t in texts]
        lengths = np.array([len(p[1]) for p in parts])
        good = _sigmoid(self.line_odds(np.vstack([p[0] for p in parts]), lengths))
        size = np.concatenate([p[1] for p in parts])
        begins = np.cumsum(lengths) - lengths
        mean = np.add.reduceat(good * size, begins) / np.add.reduceat(size, begins)
        return _sigmoid(self.scale * (mean - 0.5) + self.shift).tolist()


def _ascend(loss_grad, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam from ``start`` on a function that gives gradients."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = loss_grad(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def fit(parts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> LineField:
    """Maximum likelihood of line labels, every line carrying its document's, with a small penalty on the weights."""
    lengths = np.array([len(p[1]) for p in parts], np.int64)
    k = len(FEATURES)
    table = 3 * k * (BINS + 1)
    if not len(parts):
        return LineField(np.zeros((k, BINS - 1)), np.zeros(table), 0.0, np.zeros((2, 2)), 0.0, 0.0)
    measures = np.vstack([p[0] for p in parts])
    edges = np.quantile(measures, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # Rare values matter as much as common ones: the outer bins begin where few lines lie.
    edges[:, 0] = np.minimum(edges[:, 0], np.quantile(measures, 0.02, axis=0))
    edges[:, -1] = np.maximum(edges[:, -1], np.quantile(measures, 0.98, axis=0))
    edges = np.sort(edges, axis=1)
    model = LineField(edges, np.zeros(table), 0.0, np.zeros((2, 2)), 1.0, 0.0)
    ends = np.cumsum(lengths) - 1
    begins = ends - lengths + 1
    cells = _spread(model.bins(measures), begins, ends)
    truth = np.repeat(labels, lengths).astype(float)
    follows = np.ones(len(truth), bool)
    follows[begins] = False
    at = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[at - 1].astype(int), truth[at].astype(int)), 1.0)
    total = len(truth)

    def gradient(x: np.ndarray) -> np.ndarray:
        weights, bias, t = x[:table], x[table], x[table + 1:].reshape(2, 2)
        odds = weights[cells].sum(axis=1) + bias
        forward, backward, both = marginals(odds, lengths, t)
        error = _sigmoid(both) - truth
        grad = np.bincount(cells.ravel(), np.repeat(error, cells.shape[1]), table)
        # Pair marginals: log scores of (from, to) up to a constant, made to sum to one.
        a, b = forward[at - 1], odds[at] + backward[at]
        pair = np.stack([np.full(len(at), t[0, 0]), t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b])
        pair = np.exp(pair - pair.max(axis=0, initial=-np.inf)) if len(at) else pair
        expected = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(at) else np.zeros((2, 2))
        return np.concatenate([grad, [error.sum()], (expected - seen).ravel()]) / total + PENALTY * np.concatenate([weights, np.zeros(5)])

    x = _ascend(gradient, np.zeros(table + 5), STEPS, RATE)
    model = LineField(edges, x[:table], float(x[table]), x[table + 1:].reshape(2, 2), 1.0, 0.0)
    size = np.concatenate([p[1] for p in parts])
    good = _sigmoid(model.line_odds(measures, lengths))
    mean = np.add.reduceat(good * size, begins) / np.add.reduceat(size, begins) - 0.5

    def calibration(y: np.ndarray) -> np.ndarray:
        error = _sigmoid(y[0] * mean + y[1]) - labels
        return np.array([(error * mean).mean() + 1e-4 * y[0], error.mean()])

    scale, shift = _ascend(calibration, np.array([4.0, 0.0]), 1000, 0.05)
    return LineField(model.edges, model.weights, model.bias, model.transitions, float(scale), float(shift))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> LineField:
    """Fit the field to a bounded sample: at most ``sample`` labelled rows of at most 200 lines, drawn by the hash of the id.

    Rows without label, id or text are not learned from. With no labelled row every text scores 0.5. Only lines' measures reach the driver.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    measure = T.StructType([T.StructField("rows", T.BinaryType()), T.StructField("sizes", T.BinaryType())])

    @F.pandas_udf(measure)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [line_features(t) for t in texts]
            yield pd.DataFrame({"rows": [a.tobytes() for a, _ in found], "sizes": [b.tobytes() for _, b in found]})

    rows = (
        in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
        .join(chosen, "id").where(F.size(F.split("text", "\n")) <= SAMPLE_LINES)
        .select("id", "label", measures("text").alias("m")).orderBy("id", "label").limit(sample).collect()
    )
    parts = [(np.frombuffer(r.m.rows, np.float32).reshape(-1, len(FEATURES)), np.frombuffer(r.m.sizes, np.float64)) for r in rows]
    return fit(parts, np.array([float(r.label > 0) for r in rows]))


def score(docs: DataFrame, model: LineField, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the quality of each whole text, 0 to 1, higher for better; a column of that name is replaced.

    A NULL or empty text is scored as one empty line. Equal texts have equal scores. No shuffle; the model is a few thousand numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = texts.tolist()
            yield pd.Series([s for k in range(0, len(found), 1000) for s in sent.value.scores(found[k: k + 1000])], dtype="float64")
            release()

    return in_batches(docs).withColumn(out, quality(F.col(text_col)))
