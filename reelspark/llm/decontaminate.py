"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Benchmark texts are cut into overlapping windows of two lengths. A stretch of a
document within k edits of a window of n characters shares at least
n + 1 - q(k + 1) of its character q-grams, on diagonals that differ by at most
k. Shared q-grams are counted in overlapping bands of diagonals; the bands that
reach that number are aligned with the window inside the band.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import slices

Q, ERROR = 10, 0.08
WINDOW, STRIDE = 128, 64
#: Short windows, so close that every excerpt of 64 characters (LEAST + STEP - 1) holds a whole one.
LEAST, STEP = 56, 9
#: Bands of diagonals begin every BAND and are twice as wide; BAND exceeds every window's edits.
BAND = 16
#: Characters of benchmark text that are searched for in one pass over the documents.
BLOCK_CHARS = 1_000_000
SLICE = 1 << 20
MARKS = 1 << 22
CANDIDATES = 2048


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the ``q`` characters from every place on."""
    n = len(codes) - q + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    if n <= 0:
        return h
    m = np.uint64(0x9E3779B97F4A7C15)
    one = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(q):
            h *= m
            h += one[k:k + n]
    return h ^ (h >> np.uint64(32))


def _starts(n: int, size: int, step: int) -> list[int]:
    """Where windows of ``size`` begin in a text of ``n`` characters, the last one at its end."""
    return sorted({*range(0, max(1, n - size + 1), step), max(0, n - size)})


class Grams:
    """The places of some texts' q-grams, by q-gram."""

    def __init__(self, q: int, gram: np.ndarray, place: np.ndarray, least: int):
        order = np.argsort(gram, kind="stable")
        self.q, self.place, self.least = q, place[order], least
        self.gram, self.start = np.unique(gram[order], return_index=True)
        self.many = np.diff(np.append(self.start, len(order)))
        self.marks = np.zeros(MARKS, dtype=bool)
        self.marks[self.gram % np.uint64(MARKS)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, place in the indexed ones) of every q-gram they share."""
        gram = _grams(codes, self.q)
        at = np.flatnonzero(self.marks[gram % np.uint64(MARKS)])
        known = np.searchsorted(self.gram, gram[at])
        known[known == len(self.gram)] = 0
        real = self.gram[known] == gram[at]
        at, known = at[real], known[real]
        return np.repeat(at, self.many[known]), self.place[_ranges(self.start[known], self.many[known])]


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The ``many`` numbers from each ``start`` on, one after the other."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Windows:
    """The windows of some benchmark texts and an index of the texts' q-grams.

    The texts stand one after the other in ``flat``; a window is a stretch of
    it. Windows of one kind, long or short, are in order of their places.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = [(key, normal(text)) for key, text in items]
        texts = [(key, _codes(text)) for key, text in texts if text]
        first = np.cumsum([0, *(len(t) for _, t in texts)])
        self.flat = np.concatenate([*(t for _, t in texts), np.zeros(WINDOW, dtype=np.uint32)])
        rows = []
        for kind, (size, step) in enumerate(((WINDOW, STRIDE), (LEAST, STEP))):
            for (key, t), at in zip(texts, first, strict=False):
                if kind or len(t) > LEAST:  # shorter texts are one window, of the short kind
                    rows += [(key, at + s, min(size, len(t)), kind) for s in _starts(len(t), size, step)]
        self.item, self.at, self.size, kind = np.array(rows, dtype=np.int64).reshape(-1, 4).T.copy()
        self.kinds = [np.flatnonzero(kind == k) for k in (0, 1)]
        self.edits = np.floor(self.size * ERROR).astype(np.int64)
        # Short windows need shorter q-grams to share any in spite of their edits.
        q = np.minimum(Q, self.size // (self.edits + 1))
        self.least = self.size + 1 - q * (self.edits + 1)
        self.grams = []
        owner = np.searchsorted(first, self.at, side="right") - 1
        for n in np.unique(q):
            of = np.unique(owner[q == n])
            gram = [_grams(texts[i][1], int(n)) for i in of]
            place = [first[i] + np.arange(len(g)) for i, g in zip(of, gram, strict=True)]
            self.grams.append(Grams(int(n), np.concatenate(gram), np.concatenate(place), self.least[q == n].min()))

    @property
    def codes(self) -> np.ndarray:
        return self._codes_of(np.arange(len(self.at)))

    def _codes_of(self, window: np.ndarray) -> np.ndarray:
        """The characters of some windows, and after a shorter one whatever follows it."""
        return np.lib.stride_tricks.sliding_window_view(self.flat, WINDOW)[self.at[window]]

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, edits): where a stretch of a text is within a window's edits of it."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.item) or not texts:
            return none, none, none
        gap = "\0" * (2 * BAND)  # no alignment reaches over it
        texts = [normal(t) for t in texts]
        codes = _codes(gap + gap.join(texts) + gap)
        first = np.cumsum([2 * BAND, *(len(t) + 2 * BAND for t in texts)])[:-1]
        found = []
        for grams in self.grams:
            window, low = self._candidates(grams, codes)
            for i in range(0, len(window), CANDIDATES):
                part = slice(i, i + CANDIDATES)
                edits, middle = self._align(codes, window[part], low[part])
                hit = edits <= self.edits[window[part]]
                found.append((np.searchsorted(first, middle[hit], side="right") - 1, window[part][hit], edits[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)

    def _candidates(self, grams: Grams, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first of 2 * BAND diagonals) that share q-grams enough."""
        at, place = grams.shared(codes)
        band = (at - place + len(self.flat)) // BAND
        bands = (len(codes) + len(self.flat)) // BAND + 2
        # What is left out here is in no band that has enough for any window.
        count = np.bincount(band, minlength=bands + 1)
        pair = count[:-1] + count[1:]
        enough = np.maximum(pair[band], pair[band - 1]) >= grams.least
        place, band = place[enough], band[enough]
        keys = []
        for kind in self.kinds:
            # Windows of a kind that hold a q-gram are neighbours.
            begin = np.searchsorted((self.at + self.size)[kind], place + grams.q)
            many = np.maximum(0, np.searchsorted(self.at[kind], place, side="right") - begin)
            key = kind[_ranges(begin, many)] * bands + np.repeat(band, many)
            keys += [key, key - 1]
        key, shared = np.unique(np.concatenate(keys), return_counts=True)
        window, band = key // bands, key % bands
        enough = shared >= self.least[window]
        window, band = window[enough], band[enough]
        return window, band * BAND - len(self.flat) + self.at[window]

    def _align(self, codes: np.ndarray, window: np.ndarray, low: np.ndarray):
        """The fewest edits from each window to a stretch of text on the 2 * BAND
        diagonals from ``low`` on, with BAND more on either side to turn in, and
        the middle of that stretch."""
        width = 4 * BAND
        diagonal = np.arange(width)
        base = low - BAND
        own = self._codes_of(window)
        cost = np.zeros((len(window), width), dtype=np.int32)
        best = np.full(len(window), WINDOW, dtype=np.int32)
        middle = base.copy()
        for i in range(int(self.size[window].max()) if len(window) else 0):
            place = base[:, None] + diagonal + i
            there = np.where((place >= 0) & (place < len(codes)), codes[np.clip(place, 0, len(codes) - 1)], 0)
            step = cost + (there != own[:, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - diagonal, axis=1) + diagonal
            last = self.size[window] == i + 1
            if last.any():
                best[last] = cost[last].min(axis=1)
                middle[last] = base[last] + cost[last].argmin(axis=1) + i // 2
        return best, middle


def _blocks(benchmark: DataFrame, key: str, text: str):
    """The benchmark's windows in passes of bounded size, each as a broadcast variable."""
    items = benchmark.select(F.col(key).cast("bigint").alias("item"), F.col(text).alias("text")).filter(
        "item is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).orderBy("item", "text").collect()
        windows = Windows([(r.item, r.text) for r in part])
        yield benchmark.sparkSession.sparkContext.broadcast(windows)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, item_key, windows, edits): the benchmark texts that show in each document.

    Texts are compared in lower case with single spaces. A document holds a
    benchmark text if a stretch of it is within 8 % edits of a window (56
    characters every 9 and 128 every 64, or the whole text if shorter), so every
    excerpt of 64 characters or more shows; ``windows`` tells how many of its
    windows are found and ``edits`` the fewest edits of one. Whole documents are
    searched.

    Of benchmark texts up to 12 characters 8 % is no edit: they are searched for
    as they are, inside words too. Null and empty benchmark texts, and those with
    a null key, are not searched for; null or empty documents hold none. Repeated benchmark
    rows count once per row, repeated document rows are taken together. Empty
    tables give no rows. A benchmark of over a million characters takes one pass
    over the documents per million.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def search(shared):
        def run(batches):
            for batch in slices(batches, "text", SLICE):
                where, window, edits = shared.value.search(batch.column("text").to_pylist())
                yield pa.record_batch(
                    [batch.column("key").take(pa.array(where)), pa.array(shared.value.item[window]),
                     pa.array(window.astype(np.int64)), pa.array(edits.astype(np.int64))],
                    names=["key", "item", "window", "edits"])

        return run

    found = None
    for i, shared in enumerate(_blocks(benchmark, item_key, item_text)):
        part = rows.mapInArrow(search(shared), f"key {kind}, item bigint, window bigint, edits bigint")
        part = part.withColumn("block", F.lit(i))
        found = part if found is None else found.union(part)
    return found.groupBy(F.col("key").alias(key), F.col("item").alias(item_key)).agg(
        F.countDistinct("block", "window").alias("windows"), F.min("edits").alias("edits"))


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` without the rows in which ``find_leaks`` finds a benchmark text; no shuffle."""

    def clean(shared):
        def run(batches):
            for batch in slices(batches, text, SLICE):
                where, _, _ = shared.value.search(batch.column(text).to_pylist())
                keep = np.ones(len(batch), dtype=bool)
                keep[where] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _blocks(benchmark, item_key, item_text):
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs
