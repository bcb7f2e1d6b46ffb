import pytest

from reelspark.operators import collection as k


@pytest.fixture
def films(spark):
    rows = [(1, "One", "A|B", "x, y", 7.0), (2, "Two", "A", "y", 9.5), (3, "Three", "C | B", "z, z", None),
            (4, "Four", None, "x", 8.0)]
    return spark.createDataFrame(
        rows, "movieId bigint, title string, director string, actors string, imdb_rating double")


@pytest.fixture
def genome(spark):
    rows = [(1, 10, "dark", 0.9), (1, 2, "fun", 0.1), (2, 10, "dark", 0.5), (2, 2, "fun", 0.3)]
    return spark.createDataFrame(rows, "movieId bigint, tagId int, tag string, relevance float")


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_people(films):
    whole = k.drop_incomplete(films)
    assert _rows(k.people_counts(whole, "director")) == [("A", 2), ("B", 2), ("C", 1)]
    assert _rows(k.people_counts(whole, "actors")) == [("y", 2), ("z", 2), ("x", 1)]


def test_best_films_of_a_person(films):
    got = dict(_rows(k.top_films_by_person(k.drop_incomplete(films), "director")))
    assert got == {"A": "(Two,9.5)*|*(One,7.0)", "B": "(One,7.0)*|*(Three,nan)", "C": "(Three,nan)"}
    assert dict(_rows(k.top_films_by_person(films.filter("movieId = 3"), "actors"))) == {
        "z": "(Three,nan)"}


def test_collection(spark, rate, films, genome):
    rated = rate([(1, 1, 5.0), (1, 2, 4.5), (2, 3, 5.0), (2, 99, 5.0)])
    full = k.build_collection(rated, films, genomes=k.genome_lists(genome))
    got = {(r.userId, r.movieId): (r.title, len(r.genome)) for r in full.collect()}
    assert got == {(1, 1): ("One", 2), (2, 3): ("Three", 0), (2, 99): (None, 0)}
    only = k.build_collection(rated, films, spark.createDataFrame([(1,)], "userId bigint"))
    assert [r.movieId for r in only.collect()] == [1]


def test_genome(genome):
    first = k.genome_lists(genome).filter("movieId = 1").first().genome
    assert [(g.tagId, g.tag) for g in first] == [(2, "fun"), (10, "dark")]
    wide = {r.movieId: (r.dark, r.fun) for r in k.genome_wide(genome, ["dark", "fun"]).collect()}
    assert wide[2] == pytest.approx((0.5, 0.3))


def test_tags(genome, films):
    assert [r.tag for r in k.top_tags(genome, 5).collect()] == ["dark", "fun"]
    tops = dict(_rows(k.top_films_by_tag(genome, films)))
    assert tops == {"dark": "One*|*Two", "fun": "Two*|*One"}


@pytest.mark.parametrize("n, rows", [(0, 1), (45, 2), (1, 1)])
def test_panels_clamp(genome, films, n, rows):
    assert k.tag_panel(genome, films, n).count() == rows
    assert k.shown(45) == 30


def test_people_panel(films):
    got = {r.name: (r.n, r.top_films) for r in k.people_panel(films, "actors", 1).collect()}
    assert got == {"x": (2, "(Four,8.0)*|*(One,7.0)")}
