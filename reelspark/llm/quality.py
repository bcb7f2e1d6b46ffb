"""Document quality by a linear-chain conditional random field over lines.

The field labels every line good or bad from features of the line and of its
two neighbours. A document's quality is the mean of its lines' forward-backward
marginals, weighted by their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import slices

STEPS, RATE, DECAY = 150, 0.1, 1e-3

FEATURES = 3 * 16 + 2

# Classes of bytes.
SPACE, UPPER, LETTER, DIGIT, STOP, MARK, SYMBOL, BREAK = range(8)
CLASS = np.full(256, LETTER, dtype=np.uint8)  # bytes of longer characters count as letters
CLASS[:33] = SPACE
CLASS[33:128] = SYMBOL
CLASS[[*range(65, 91)]] = UPPER
CLASS[[*range(97, 123)]] = LETTER
CLASS[[*range(48, 58)]] = DIGIT
CLASS[[*b".,;:'\"()-"]] = STOP
CLASS[[*b"!?"]] = MARK
CLASS[10] = BREAK


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, number of lines of each text, bytes of each line)."""
    if not texts:
        return np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = b"".join(t + b"\n" for t in texts)
    a = np.frombuffer(whole, dtype=np.uint8)
    kind = CLASS[a]
    ends = np.flatnonzero(kind == BREAK)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts  # without the line break
    lines = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)

    def per_line(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, starts, dtype=np.int64)

    line = np.repeat(np.arange(len(starts)), size + 1)
    count = {c: per_line(kind == c) for c in (SPACE, UPPER, LETTER, DIGIT, STOP, MARK, SYMBOL)}
    solid = (kind != SPACE) & (kind != BREAK)
    begins = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    words = np.bincount(line[begins], minlength=len(starts))
    # A hash of each word, to tell whether it repeats the one before.
    rng = np.random.default_rng(5)
    byte, turn = (rng.integers(1, 1 << 62, 256, dtype=np.uint64) for _ in range(2))
    if len(begins):
        long = np.diff(np.append(begins, len(a)))
        place = np.arange(begins[0], len(a)) - np.repeat(begins, long)
        own = np.where(solid[begins[0]:], byte[a[begins[0]:]] * turn[place & 255], np.uint64(0))
        hashes = np.add.reduceat(own, begins - begins[0])
        tail = np.flatnonzero(solid & np.append(~solid[1:], True))
        odd = np.isin(kind[tail], (SYMBOL, MARK))
    else:
        hashes, odd = np.zeros(0, np.uint64), np.zeros(0, bool)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[begins[1:]] == line[begins[:-1]])
    text = np.repeat(np.arange(len(texts)), lines)
    whole_line = np.zeros(len(starts), dtype=np.uint64)
    nth = np.arange(len(hashes)) - np.searchsorted(line[begins], line[begins])  # of its line's words
    np.add.at(whole_line, line[begins], hashes * (nth.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    in_text = whole_line + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, which, times = np.unique(in_text, return_inverse=True, return_counts=True)
    repeated = (times[which] > 1) & (words > 0)
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(count[UPPER] + count[LETTER], 1)
    own = np.stack([
        np.log1p(size), np.log1p(words), size == 0, count[UPPER] / letters, (count[UPPER] + count[LETTER]) / n,
        count[DIGIT] / n, count[STOP] / n, count[MARK] / n, count[SYMBOL] / n, count[SPACE] / n,
        np.minimum(size / w, 30) / 10, np.bincount(line[begins], again, minlength=len(starts)) / w,
        np.bincount(line[begins], odd, minlength=len(starts)) / w, repeated,
        np.minimum(count[SYMBOL] / w, 4), np.minimum(count[MARK] / w, 4),
    ], axis=1).astype(np.float64)
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    edge = np.zeros((len(own), 2))
    edge[first, 0], edge[last, 1] = 1, 1
    return np.concatenate([own, before, after, edge], axis=1), lines, size


class Chains:
    """Sequences of different lengths, walked through side by side, longest first."""

    def __init__(self, lines: np.ndarray):
        first = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        self.first, self.lines, self.opening = first[order], lines[order], first
        longest = int(self.lines[0]) if len(lines) else 0
        self.live = np.searchsorted(-self.lines, -np.arange(longest), side="left")
        self.total = int(lines.sum())

    def marginals(self, score: np.ndarray, move: np.ndarray, begin: np.ndarray):
        """(probability of good by line, expected moves, probability of good at the first line).

        ``score`` is by how much each line favours good, ``move`` the score of
        going from one label to another, ``begin`` that of the first label.
        """
        good = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        emit = np.stack([1 - good, good], axis=1)
        step = np.exp(move)
        ahead, back = np.empty((self.total, 2)), np.ones((self.total, 2))
        for t, n in enumerate(self.live):
            at = self.first[:n] + t
            x = emit[at] * (np.exp(begin) if t == 0 else ahead[at - 1] @ step)
            ahead[at] = x / x.sum(axis=1, keepdims=True)
        moves = np.zeros((2, 2))
        for t in range(len(self.live) - 1, 0, -1):
            at = self.first[:self.live[t]] + t
            after = emit[at] * back[at]
            pair = ahead[at - 1][:, :, None] * step * after[:, None, :]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            x = after @ step.T
            back[at - 1] = x / x.sum(axis=1, keepdims=True)
        both = ahead * back
        both /= both.sum(axis=1, keepdims=True)
        return both[:, 1], moves, both[self.opening, 1]


class Model:
    def __init__(self, mean, spread, weight, bias, move, begin):
        self.mean, self.spread, self.weight, self.bias = mean, spread, weight, bias
        self.move, self.begin = move, begin

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, lines, size = line_features(texts)
        emit = (x - self.mean) / self.spread @ self.weight + self.bias
        good, _, _ = Chains(lines).marginals(emit, self.move, self.begin)
        text = np.repeat(np.arange(len(texts)), lines)
        length = size + 1e-9  # so that a text of empty lines has a mean too
        return np.clip(np.bincount(text, good * length) / np.bincount(text, length), 0, 1)


def train(texts: list[str], labels: np.ndarray) -> Model:
    """Fit the field by Adam on the conditional likelihood of the line labels.

    Only documents have labels; every line of a whole text takes its document's. Without texts
    of both classes all weights are zero, so every score is one half.
    """
    labels = np.asarray(labels, dtype=np.int64)
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    x, lines, _ = line_features(encoded)
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    spread = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(x.shape[1])
    x = (x - mean) / spread
    state = [np.zeros(x.shape[1]), np.zeros(1), np.zeros((2, 2)), np.zeros(2)]
    if len(np.unique(labels)) == 2:
        y = np.repeat(labels, lines)
        chains = Chains(lines)
        same = np.array([(lines - 1)[labels == 0].sum(), (lines - 1)[labels == 1].sum()])
        moment = [[np.zeros_like(s), np.zeros_like(s)] for s in state]
        for k in range(1, STEPS + 1):
            weight, bias, move, begin = state
            good, moves, opening = chains.marginals(x @ weight + bias, move, begin)
            miss = (good - y) / len(y)
            start = np.array([(1 - opening).sum() - (labels == 0).sum(), opening.sum() - (labels == 1).sum()])
            grads = [x.T @ miss + DECAY * weight, np.array([miss.sum()]),
                     (moves - np.diag(same)) / len(y) + DECAY * move, start / len(y) + DECAY * begin]
            for s, g, (m, v) in zip(state, grads, moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                s -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weight, bias, move, begin = state
    return Model(mean, spread, weight, float(bias[0]), move, begin)


def keep(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; no shuffle."""

    def run(batches):
        for batch in slices(batches, text):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row of ``docs``; higher is better.

    Whole texts count. A null text is scored as an empty one, which is a single
    empty line; repeated rows give repeated rows. The model, some hundred
    numbers, goes to the tasks with the function.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(model.score(texts))], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
