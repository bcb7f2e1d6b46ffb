import re

import pytest
from pyspark.sql import functions as F

from reelspark.operators import ratings as ra
from reelspark.sources import ratings_store
from reelspark.sources.ratings_store import ConcurrentUpdate, RatingsStore


def _rows(df):
    return sorted((r.userId, r.movieId, r.rating, r.full_train) for r in df.collect())


@pytest.fixture
def rated(rate):
    return rate([(u, m, float(u % 5 + 1)) for u in range(60) for m in range(u % 7, 40, 7)], True)


@pytest.fixture
def store(rated, tmp_path):
    return RatingsStore.create(rated, str(tmp_path / "store"), buckets=32)


def test_touched_rows_are_those_of_the_table(store, rated, rate):
    batch = rate([(3, 5, 5.0), (99, 7, 1.0)])
    assert _rows(store.touched(batch)) == _rows(ra.touched_rows(rated, batch))
    assert _rows(store.rows()) == _rows(rated)


def test_a_batch_reads_its_buckets_only(store, rate):
    """A thousand ratings of three users and four films: every scan is bound to a few of the 32 buckets."""
    batch = rate([(u, m, 2.0) for u in (1, 2, 3) for m in (1, 2, 3, 4)] * 84)
    later = store.apply(rate([(1, 1, 5.0), (50, 2, 4.0)], True))
    plan = later.touched(batch)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in re.findall(r"FileScan parquet \[userId.*", plan)]
    bound = [re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", x) for x in scans]
    assert len(scans) == 6 and all(bound)  # by user and by film the whole part once, the delta twice
    assert all(len((b[1] or b[2]).split(",")) <= 4 for b in bound)


def test_deltas_are_merged(store, rated, rate, spark):
    new = rate([(1, 1, 5.0), (70, 70, 3.0)], True)
    pairs = spark.createDataFrame([(2, 2), (70, 70)], "userId bigint, movieId bigint")
    once = store.apply(new)
    twice = once.apply(rate([(1, 1, 1.0)], True), pairs)
    want = {(r[0], r[1]): r for r in _rows(rated)} | {(1, 1): (1, 1, 1.0, True)}
    want.pop((2, 2))
    assert _rows(twice.rows()) == sorted(want.values())
    assert (70, 70, 3.0, True) in _rows(once.rows())
    films = spark.createDataFrame([(1,), (2,)], "movieId bigint")
    assert _rows(twice.of_films(films)) == sorted(r for r in want.values() if r[1] in (1, 2))
    again = RatingsStore.latest(spark, store.path)
    assert again.manifest == twice.manifest and _rows(again.rows()) == _rows(twice.rows())


def test_compaction_by_policy(store, rate, monkeypatch):
    monkeypatch.setattr(ratings_store, "MOST_DELTAS", 2)
    for n in range(3):
        assert not store.due()
        store = store.apply(rate([(n, 39, 1.0)], True))
    before = _rows(store.rows())
    assert store.due()
    whole = store.compact()
    assert whole.manifest.deltas == () and _rows(whole.rows()) == before == _rows(store.rows())
    assert whole.compact() is whole
    assert len(whole.clean()) == 4 and _rows(RatingsStore.latest(whole.spark, whole.path).rows()) == before


def test_of_two_writers_one_wins(store, rate, spark):
    one = store.apply(rate([(1, 1, 5.0)], True))
    with pytest.raises(ConcurrentUpdate):
        store.apply(rate([(1, 1, 4.0)], True))
    assert _rows(RatingsStore.latest(spark, store.path).rows()) == _rows(one.rows())


def test_a_writer_that_fails_changes_nothing(store, rate, spark, monkeypatch):
    before = _rows(store.rows())
    monkeypatch.setattr(RatingsStore, "_commit", lambda self, manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.apply(rate([(1, 1, 5.0)], True))
    assert _rows(RatingsStore.latest(spark, store.path).rows()) == before


def test_large_buckets_are_dealt_to_several_files(rated, tmp_path, monkeypatch):
    monkeypatch.setattr(ratings_store, "FILE_ROWS", 20)
    store = RatingsStore.create(rated, str(tmp_path / "split"), buckets=2)
    files = list((tmp_path / "split" / store.manifest.base / "by_film").rglob("*.parquet"))
    assert len(files) > 4 and _rows(store.rows()) == _rows(rated)


def test_empty_tables(rate, tmp_path):
    store = RatingsStore.create(rate([], True).filter(F.lit(False)), str(tmp_path / "none"))
    assert _rows(store.rows()) == [] and store.apply(rate([], True)) is store
    assert _rows(store.apply(rate([(1, 2, 3.0)], True)).rows()) == [(1, 2, 3.0, True)]
