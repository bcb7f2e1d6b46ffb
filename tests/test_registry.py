"""Every operator of the blueprint is registered, and the flagship query runs."""

import __spark_entry__ as entry

COUNTS = {"s": 8, "c": 6, "e": 8, "f": 14, "v": 9, "t": 5, "k": 9}


def test_every_operator_has_a_query():
    have = {name.split("_")[0] for name in entry.QUERIES}
    assert have == {f"{g}{i}" for g, n in COUNTS.items() for i in range(1, n + 1)}


def test_all_of_them_have_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    top = entry.entry(spark)
    assert top.columns == ["userId", "movieId", "predictedRating", "position"]
    assert top.count() == 150 * 20
