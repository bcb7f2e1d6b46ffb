import numpy as np
import pandas as pd
import pytest

from reelspark.functions.ordering import order_key
from reelspark.functions.ranking import rank_all
from reelspark.operators import statistics as st


@pytest.fixture
def ratings(rate):
    return rate([(1, 1, 5.0), (1, 2, 4.0), (1, 3, 5.0), (2, 1, 5.0), (3, 4, 1.0)])


def test_totals(ratings):
    assert tuple(st.totals(ratings).first()) == (5, 3, 4)


@pytest.mark.parametrize("min_rows", [1, 100_000])
def test_sizes(ratings, min_rows):
    got = {(r.userId, r.movieId): (r.num_ratings_user, r.num_ratings_movie)
           for r in st.with_profile_sizes(ratings, min_rows).collect()}
    assert got == {(1, 1): (3, 2), (1, 2): (3, 1), (1, 3): (3, 1), (2, 1): (1, 2), (3, 4): (1, 1)}


def test_description_is_that_of_pandas(spark):
    values = [1, 2, 2, 5, 9, 30]
    df = spark.createDataFrame([(x,) for x in values], "n int")
    got = {r.statistic: r.value for r in st.describe(df).collect()}
    want = pd.Series(values).describe(percentiles=np.arange(0, 1, 0.05))
    assert set(got) == set(want.index)
    for k, x in want.items():
        assert got[k] == pytest.approx(x)


def test_unique_raters(ratings):
    counts, share, described = st.unique_raters(ratings)
    assert {r.userId: r.unique_films for r in counts.collect()} == {1: 2, 2: 0, 3: 1}
    assert share.first().share == pytest.approx(2 / 3)
    assert {r.statistic: r.value for r in described.collect()}["mean"] == 1.5


@pytest.mark.parametrize("values", [[1, 2, 2, 3, 7, 50, 100, 101, 0], [4, 4, 4], list(range(1, 101))])
def test_histogram_is_that_of_numpy(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "n int")
    got = st.histogram(df, "n").orderBy("bin").collect()
    inside = [x for x in values if 1 <= x <= 100]
    counts, edges = np.histogram(inside, bins=50)
    assert [r.n for r in got] == list(counts)
    assert [r.left for r in got] == pytest.approx(list(edges[:-1]))


def test_popularity(ratings):
    got = {r.userId: r for r in st.popularity_by_user(ratings).collect()}
    assert got[1].num_ratings_movie_mean == pytest.approx(4 / 3)
    assert got[1].num_ratings_movie_std == pytest.approx(np.std([2, 1, 1], ddof=1))
    assert got[3].num_ratings_movie_std is None


def test_sample(ratings):
    got = st.sample_users(ratings, 2, seed=5).collect()
    users = {r.userId for r in got}
    assert len(users) == 2
    assert len(got) == ratings.filter(ratings.userId.isin(*users)).count()
    assert got == st.sample_users(ratings, 2, seed=5).collect()


def test_samples_of_one_pass_are_those_of_a_full_ranking(rate, monkeypatch):
    rated = rate([(u, m, 1.0) for u in range(300) for m in range(u % 3 + 1)])
    wanted = [(5, 1), (40, 2), (0, 3), (1000, 4)]

    def ranked(n, seed):
        keyed = rated.select("userId").distinct().withColumn("_key", order_key(seed, rated.userId))
        return sorted(r.userId for r in rank_all(keyed, "_key", "userId", "_rn").filter(f"_rn <= {n}").collect())

    def got():
        rows = st.choose_samples(rated, wanted).collect()
        return [sorted(r.userId for r in rows if r.sample == i) for i in range(len(wanted))]

    want = [ranked(n, seed) for n, seed in wanted]
    assert got() == want and [len(x) for x in want] == [5, 40, 0, 300]
    plan = st.choose_samples(rated, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a task hands on a bounded summary
    monkeypatch.setattr(st, "SLICE_ROWS", 100)
    assert got() == want


def test_top_raters(ratings):
    assert [tuple(r) for r in st.top_raters(ratings).collect()] == [(1, 2), (2, 1)]
