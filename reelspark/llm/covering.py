"""Covering codes: sets of anchor words near which every bit string lies.

A code here is a sum of short perfect codes. A word's home is the anchor within
the covering radius in every part. If two words differ in at most ``budget``
bits, the home of one is an anchor of the other whose distance exceeds the
radii by no more than ``budget`` in total, so ``visits`` lists every home that a
word's partners can have.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np


@dataclass(frozen=True)
class Part:
    """A linear code by its check columns; every word is within ``radius`` of one codeword."""

    columns: tuple[int, ...]
    radius: int

    @property
    def bits(self) -> int:
        return len(self.columns)


def _golay() -> Part:
    # Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the perfect 23-bit code.
    column, columns = 1, []
    for _ in range(23):
        columns.append(column)
        column <<= 1
        if column >> 11:
            column ^= 0b101011100011
    return Part(tuple(columns), 3)


GOLAY = _golay()  # 12 free bits of 23
HAMMING_7 = Part(tuple(range(1, 8)), 1)  # 4 of 7
HAMMING_3 = Part((1, 2, 3), 1)  # 1 of 3
BIT = Part((0,), 0)  # every word is a codeword


class Anchors:
    """The anchors of the bits from ``shift`` on, for partners that differ in ``budget`` bits."""

    def __init__(self, parts: list[Part], shift: int, budget: int):
        self.budget, self.steps = budget, []
        for part in parts:
            self.steps.append((shift, part, *self._patterns(part, budget)))
            shift += part.bits

    @staticmethod
    def _patterns(part: Part, budget: int):
        """Per syndrome, the patterns that lead to a codeword, cheapest first."""
        rows = []
        for weight in range(min(part.bits, part.radius + budget) + 1):
            for places in combinations(range(part.bits), weight):
                syndrome = reduce(lambda s, i: s ^ part.columns[i], places, 0)
                rows.append((syndrome, max(0, weight - part.radius), sum(1 << i for i in places)))
        syndrome, cost, pattern = np.array(sorted(rows), dtype=np.int64).T
        many = 1 << max(part.columns).bit_length()
        first = np.searchsorted(syndrome, np.arange(many))
        within = np.zeros((many, budget + 1), dtype=np.int64)
        for c in range(budget + 1):
            within[:, c] = np.bincount(syndrome[cost <= c], minlength=many)
        return first, within, cost, pattern.astype(np.uint64)

    def visits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, anchor, cost); cost 0 marks the home, one per word."""
        index = np.arange(len(words))
        anchor = np.zeros(len(words), dtype=np.uint64)
        left = np.full(len(words), self.budget)
        for shift, part, first, within, cost, pattern in self.steps:
            own = (words >> np.uint64(shift)) & np.uint64((1 << part.bits) - 1)
            syndrome = np.zeros(len(words), dtype=np.int64)
            for i, column in enumerate(part.columns):
                syndrome ^= np.where((own >> np.uint64(i)) & np.uint64(1), column, 0)
            s = syndrome[index]
            many = within[s, left]
            up = np.repeat(np.arange(len(index)), many)
            nth = np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
            chosen = first[s[up]] + nth
            index, left = index[up], left[up] - cost[chosen]
            anchor = anchor[up] | ((own[index] ^ pattern[chosen]) << np.uint64(shift))
        return index, anchor, self.budget - left
