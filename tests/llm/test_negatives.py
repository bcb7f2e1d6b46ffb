import math
import random

import numpy as np
import pytest

from reelspark.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, row int, cell int, slot string"


def slow(rows, every=5, positives=5, count=3, low=50, high=95):
    """The definition; rows are (vec_id, vector, label)."""
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, y in good:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, z) for i, w, z in good if i != a)
        for s, p, _ in [r for r in scored if r[2] == y][:positives]:
            fits = [(n, -m) for m, n, z in scored if z != y and low * -s <= 100 * -m <= high * -s]
            out += [(a, p, k + 1, n, -s, m) for k, (n, m) in enumerate(fits[:count])]
    return sorted(out)


def run(spark, rows, every=5, **how):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = negatives.hard_negatives(frame, lambda key: key % every == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clusters(n, width=6, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


def test_against_brute_force(spark):
    rows = clusters(150) + [(i, [0.25] * 6, i % 3) for i in range(150, 190)]  # equal vectors, so many ties
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows, positives=2, negatives=4, low=10, high=80) == slow(rows, 5, 2, 4, 10, 80)


def test_many_places(spark, monkeypatch):
    for name, value in (("DATA_TILE", 9), ("ANCHOR_TILE", 4), ("RUN", 3), ("STRIP", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = clusters(80, 3, 2)
    assert run(spark, rows) == slow(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (5, None, 1), (10, [1.0, None], 1), (1, [float("nan"), 1.0], 1), (2, [float("inf")], 2),
            (3, [0.5, -0.001], 1), (None, [1.0, 1.0], 1), (15, [], 2), (4, [3.0], 2), (6, [0.4, 0.2], 2), (7, [1.0, 1.0], None),
            (20, [0.0, 0.0], 1), (8, [0.0], 2), (25, [-1.0, -1.0], 1), (9, [0.3, 0.3], 2), (9, [0.3, 0.3], 2)]
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows[1:5]) == [] and run(spark, []) == []
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == slow([(0, [], 1), (1, [], 1), (2, [], 2)])


def test_repeated_anchors_count_each(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]
    assert run(spark, rows) == slow(rows) and len(slow(rows)) == 2


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20 + 1, 3.0], 1), (1, [2.0**20 + 3, 1.0], 1), (2, [2.0**19 + 2, 2.0], 2), (3, [2.0**19 + 2, 2.1], 2)]
    assert run(spark, rows) == slow(rows)


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (400, 8))
    x[:3] = 0
    refs = np.eye(8)[:3]
    norm, theta = negatives.angles(x, refs)
    stored = theta.astype(np.float32).astype(float)
    order = np.argsort(stored[:, 0])
    first = np.arange(0, 400, 20)
    ends = [f.reduceat(stored[order], first, axis=0) for f in (np.minimum, np.maximum)]
    sizes = [f.reduceat(norm[order], first) for f in (np.minimum, np.maximum)]
    lower, upper = negatives.intervals(norm, theta, *ends, *sizes)
    score = (x @ x[order].T).reshape(400, 20, 20)
    assert (lower[:, :, None] <= score).all() and (score <= upper[:, :, None]).all()
    near = negatives.intervals(norm[:1] + 1, np.zeros((1, 3)), *ends, *sizes)
    assert (near[1] < near[1].max()).any()  # some runs can be left out
