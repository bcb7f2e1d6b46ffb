import math
import random

import pytest

from reelspark.llm import topk


def slow(rows, every, k):
    """The definition; rows are (vec_id, vector)."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def _run(spark, rows, every=5, k=5, **how):
    frame = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id bigint, embedding array<double>, cell int, id int")
    got = topk.top_k(frame, lambda key: key % every == 0, k, **how)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("pivots", [1, 4, 500])
def test_against_brute_force(spark, pivots):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(150)]
    rows += [(i, [0.25] * 6) for i in range(150, 200)]  # equal vectors, so many ties
    assert _run(spark, rows, pivots=pivots) == slow(rows, 5, 5)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "DATA_TILE", 7)
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    assert _run(spark, rows, pivots=3) == slow(rows, 5, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]),
            (3, [0.5, -0.001]), (None, [1.0, 1.0]), (15, []), (4, [3.0])]
    assert _run(spark, rows) == slow(rows, 5, 5)
    assert _run(spark, rows[:1]) == [] and _run(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20 + 1, 3.0]), (1, [2.0**20 + 3, 1.0]), (2, [2.0**20 + 2, 2.0])]
    assert _run(spark, rows) == slow(rows, 5, 5)


def test_data_go_only_where_queries_are(spark):
    """A vector is copied once for each block of its own cell, and not at all without one."""
    data = spark.createDataFrame([(c, i, [1]) for c in range(4) for i in range(50)], "cell int, id bigint, v array<bigint>")
    got = topk.copies(data, {c: 3 for c in range(4)}, {0: 1, 2: 2}).groupBy("cell").count().collect()
    assert {r.cell: r["count"] for r in got} == {0: 50, 2: 100}
    queries = spark.createDataFrame([(0, i, [1]) for i in range(4)] + [(2, 1, [1])], "cell int, id bigint, v array<bigint>")
    assert topk._asked(queries) == {0: 1, 2: 1}
