import pytest

from reelspark.operators import catalogue as c


def _column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def test_numbers(spark):
    got = c.parse_numeric(_column(spark, ["1,234", "N/A", "7.5", None, "?"]), "x")
    assert [r.x for r in got.collect()] == [1234.0, None, 7.5, None, None]


def test_certificates(spark):
    raw = ["nr", "Unrated", "M/PG", "PG", "Not Rated", None]
    got = c.normalise_certificate(_column(spark, raw), "x")
    assert [r.x for r in got.collect()] == ["NOT RATED", "NOT RATED", "M", "PG", "NOT RATED", None]


@pytest.mark.parametrize("text, sep, trim, want", [
    (" b, a,C", ",", True, "C|a|b"),
    (" b, a,C", ",", False, " a| b|C"),
    ("War|Drama|Action", "|", False, "Action|Drama|War"),
    ("a||b", "|", False, "|a|b"),
    ("\t x\xa0,\ny ", ",", True, "x|y"),
    ("one", ",", True, "one"),
    ("", ",", True, ""),
])
def test_lists(spark, text, sep, trim, want):
    assert c.canonical_list(_column(spark, [text]), "x", sep, trim).first().x == want


def test_value_counts(spark):
    df = _column(spark, ["a|b", "a", None, "c | b"])
    counted = {r.value: r.n for r in c.value_counts(df, "x", "|", True).collect()}
    assert counted == {"a": 2, "b": 2, "c": 1}
    assert {r.value: r.n for r in c.value_counts(df, "x").collect()} == {"a|b": 1, "a": 1, "c | b": 1}


def test_override_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, x string")
    got = sorted(tuple(r) for r in c.override_rows(old, new, "k").collect())
    assert got == [(1, "a"), (2, "c"), (3, "d")]


def test_enrich(spark):
    schema = "movieId bigint, " + ", ".join(f"{f} string" for f in c.LOOKUP_FIELDS)
    movies = spark.createDataFrame([(i, *["old"] * 13) for i in (1, 2, 3)], schema)
    links = spark.createDataFrame([(1, "tt1"), (2, "tt2"), (3, "tt3")], "movieId bigint, imdbId string")
    full = ["new"] * 13
    gap = ["new", "new", None, "new", None, *["new"] * 8]
    records = spark.createDataFrame(
        [("tt1", *full), ("tt2", *gap)], schema.replace("movieId bigint", "imdbId string"))
    filled, gaps = c.enrich(movies, links, records)
    rows = {r.movieId: r for r in filled.collect()}
    assert rows[1].rated == "new" and rows[2].rated == "old" and rows[2].plot == "new"
    assert rows[3].title == "old"
    assert sorted(tuple(g) for g in gaps.collect()) == [("tt2", "rated"), ("tt3", "title")]
