import pytest

from reelspark.operators import factors as fa
from reelspark.operators import ratings as ra


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert(rate):
    old = rate([(1, 2, 3.0), (1, 3, 4.0)])
    new = rate([(1, 2, 5.0), (2, 2, 1.0)])
    want = [(1, 2, 5.0), (1, 3, 4.0), (2, 2, 1.0)]
    once = ra.upsert_ratings(old, new)
    assert _rows(once) == want
    assert _rows(ra.upsert_ratings(once, new)) == want


def test_upsert_keeps_the_flag(rate):
    old = rate([(1, 2, 3.0), (1, 3, 4.0)], True)
    new = rate([(1, 2, 5.0), (2, 2, 1.0)])
    got = {(r.userId, r.movieId): r.full_train for r in ra.upsert_ratings(old, new).collect()}
    assert got == {(1, 2): True, (1, 3): True, (2, 2): None}


def test_the_latest_of_a_batch_wins(spark, rate):
    new = spark.createDataFrame(
        [(1, 2, 5.0, 1), (1, 2, 4.0, 2)], "userId bigint, movieId bigint, rating float, seq int")
    assert _rows(ra.upsert_ratings(rate([(1, 3, 4.0)]), new)) == [(1, 2, 4.0), (1, 3, 4.0)]


def test_ownership(spark, rate):
    pairs = spark.createDataFrame([(1, 3), (7, 7)], "userId bigint, movieId bigint")
    got = ra.add_to_collection(rate([(1, 3, 1.0)]), pairs)
    assert _rows(got) == [(1, 3, 4.0), (7, 7, 4.0)]


def test_remove(spark, rate):
    old = rate([(1, 2, 3.0), (1, 3, 3.0), (2, 2, 3.0)])
    pairs = spark.createDataFrame([(1, 2)], "userId bigint, movieId bigint")
    assert _rows(ra.remove_ratings(old, pairs)) == [(1, 3, 3.0), (2, 2, 3.0)]


@pytest.mark.parametrize("min_rows", [5, 100_000])
def test_selection_counts_trained_rows_only(rate, min_rows):
    rows = [(1, m, 3.0, True) for m in range(20)]
    rows += [(2, m, 3.0, True) for m in range(21)]
    rows += [(3, m, 3.0, None) for m in range(25)]
    batch = rate([(u, 0, 3.0) for u in (1, 2, 3)])
    users, films = ra.select_for_update(rate(rows, True), batch, 20, min_rows)
    assert {r.userId for r in users.collect()} == {1, 3}
    assert users.count() == 45
    assert {r.movieId for r in films.collect()} == {0}


def test_touched_rows(rate):
    rated = rate([(1, 1, 1.0), (1, 2, 1.0), (2, 2, 1.0), (3, 3, 1.0)])
    batch = rate([(1, 3, 5.0), (1, 1, 5.0)])
    assert _rows(ra.touched_rows(rated, batch).select("userId", "movieId")) == [(1, 1), (1, 2), (3, 3)]


def test_average(factors, spark):
    proposed = spark.createDataFrame(
        [(7, [1.0, 3.0]), (7, [3.0, 5.0]), (8, [1.0, 1.0])], "id bigint, features array<float>")
    assert _rows(fa.average_factors(proposed, 2)) == [(7, [2.0, 4.0]), (8, [1.0, 1.0])]


def test_merge_factors(factors):
    got = fa.merge_factors(factors({1: (1, 1)}), factors({1: (2, 2), 2: (3, 3)}))
    assert _rows(got) == [(1, [2.0, 2.0]), (2, [3.0, 3.0])]


def test_merge_predictions(rate):
    old = rate([(1, 2, 3.0), (1, 3, 4.0)]).withColumnRenamed("rating", "predictedRating")
    new = rate([(1, 2, 5.0), (2, 2, 1.0)]).withColumnRenamed("rating", "predictedRating")
    assert _rows(fa.merge_predictions(old, new)) == [(1, 2, 5.0), (1, 3, 4.0), (2, 2, 1.0)]
