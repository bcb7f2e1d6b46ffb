import hashlib
import math
import random

import numpy as np
import pytest

from reelspark.llm import kmeans

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def slow(rows, k, rounds, width, salt="2:"):
    """The definition; rows are (vec_id, vector)."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    centre = [v for _, v in sorted(good, key=lambda r: (hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre)) for _, v in good]

    for _ in range(rounds):
        near = [j for _, j in assign()]
        for j in range(len(centre)):
            own = [v for (_, v), n in zip(good, near, strict=True) if n == j]
            if own:
                centre[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    total = {j: sum(d for d, n in found if n == j) for j in range(len(centre))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted((i, j, d, total[j], sum(total.values()), digest[j]) for (i, _), (d, j) in zip(good, found, strict=True))


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id bigint, embedding array<double>, block int, id string")
    got = kmeans.k_means(frame, **how)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def blobs(n, width=5, seed=1, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("k, rounds, block", [(6, 4, 16), (1, 2, 7), (12, 0, 64), (40, 5, 1000)])
def test_against_brute_force(spark, k, rounds, block):
    rows = blobs(150) + [(i, [0.25] * 5) for i in range(150, 160)]
    assert run(spark, rows, k=k, rounds=rounds, width=5, block=block) == slow(rows, k, rounds, 5)


def test_only_expired_vectors_are_compared(spark):
    rows, log = blobs(400, spread=0.05), []
    assert run(spark, rows, k=6, rounds=8, width=5, block=50, log=log) == slow(rows, 6, 8, 5)
    assert len(log) == 9 and log[0] == 400 and log[-1] < 100


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [0.5]),
            (None, [1.0, 1.0]), (15, []), (4, [3.0, -3.0]), (4, [3.0, -3.0]), (6, [0.0, -0.001])]
    assert run(spark, rows, k=3, rounds=3, width=2) == slow(rows, 3, 3, 2)
    assert run(spark, rows[1:3], width=2) == [] and run(spark, [], width=2) == []


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [1.0, 1.0]) for i in range(9)] + [(9, [4.0, 4.0])]
    got = run(spark, rows, k=5, rounds=3, width=2)
    assert got == slow(rows, 5, 3, 2) and len({r[1] for r in got}) < 5


def test_large_components(spark):
    rows = [(i, [2.0**18 + i, -(2.0**18) - i * i]) for i in range(12)]
    assert run(spark, rows, k=3, rounds=2, width=2) == slow(rows, 3, 2, 2)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, [2.0**40, 0.0]), (1, [0.0, 1.0])], k=1, rounds=1, width=2)


def test_no_vector_changes_unseen():
    """Bounds after moves of the centroids, against a full comparison."""
    rng = np.random.default_rng(2)
    x, centre = rng.integers(-400, 400, (500, 4)), rng.integers(-400, 400, (7, 4))
    near, gap = kmeans.measure(x, centre)
    heaps = kmeans.Heaps(np.arange(500, dtype="<i4"), near.astype("<i4"), gap)
    shift = rng.integers(-40, 40, centre.shape)
    drift = np.sqrt((shift**2).sum(axis=1))
    offset = drift + np.array([np.delete(drift, j).max() for j in range(7)])
    out = heaps.expired(offset)
    after, _ = kmeans.measure(x, centre + shift)
    assert (after[heaps.member[~out]] == heaps.cluster[~out]).all() and 0 < (~out).sum() < 500


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    run(spark, blobs(30), k=3, rounds=1, width=5)
    assert {t.name for t in spark.catalog.listTables()} == before
