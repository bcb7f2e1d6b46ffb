from concurrent.futures import ThreadPoolExecutor

import pytest

from reelspark.sources import manifests
from reelspark.sources.keyed_table import KeyedTable
from reelspark.sources.tables import KeyViolation


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "movieId bigint, tagId int, relevance double")


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "scores"), ["movieId", "tagId"])


def _keys(table):
    rows = table.read()
    return [] if rows is None else sorted((r.movieId, r.tagId) for r in rows.collect())


def test_append_and_violations(table, make):
    assert _keys(table) == []
    assert table.append(make([(1, 1, 0.1), (1, 2, 0.2)])) == 2
    for bad in ([(2, 1, 0.0), (2, 1, 0.1)], [(None, 1, 0.0)], [(5, 5, 0.0), (1, 2, 0.9)]):
        with pytest.raises(KeyViolation):
            table.append(make(bad))
    assert _keys(table) == [(1, 1), (1, 2)]
    assert table.append(make([(1, 2, 0.9), (3, 1, 0.3)]), skip_present=True) == 1
    assert table.append(make([(1, 2, 0.9)]), skip_present=True) == 0 and table.append(make([])) == 0
    assert _keys(table) == [(1, 1), (1, 2), (3, 1)]


def test_only_files_that_can_hold_a_key_are_compared(table, make):
    for n in range(6):
        table.append(make([(100 * n + k, 1, 0.5) for k in range(20)]))
        assert table.compared == 0  # later ranges
    table.append(make([(305, 2, 0.5), (310, 2, 0.5)]))
    assert 1 <= table.compared < table.files / 2
    with pytest.raises(KeyViolation):
        table.append(make([(305, 2, 0.5)]))


def test_of_two_appends_of_a_key_one_stays(table, make, spark):
    table.append(make([(0, 0, 0.0)]))

    def one(value):
        other = KeyedTable(spark, table.path, table.keys)
        try:
            return other.append(make([(7, 7, value), (8, int(value), value)]))
        except KeyViolation:
            return 0

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(one, [1.0, 2.0])) == [0, 2]
    assert _keys(table).count((7, 7)) == 1 and len(_keys(table)) == 3


def test_a_loser_checks_again(table, make, spark, monkeypatch):
    """A writer that finds its number taken sees what the other one wrote."""
    table.append(make([(0, 0, 0.0)]))
    commit, first = manifests.commit, []

    def late(spark_, path, number, fields):
        if not first:
            first.append(1)
            KeyedTable(spark, table.path, table.keys).append(make([(7, 7, 1.0)]))
        commit(spark_, path, number, fields)

    monkeypatch.setattr(manifests, "commit", late)
    assert table.append(make([(7, 7, 2.0), (9, 9, 2.0)]), skip_present=True) == 1
    assert _keys(table) == [(0, 0), (7, 7), (9, 9)]


def test_a_crash_leaves_none(table, make, monkeypatch):
    table.append(make([(0, 0, 0.0)]))
    monkeypatch.setattr(manifests, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.append(make([(1, 1, 0.0)]))
    assert _keys(table) == [(0, 0)]
