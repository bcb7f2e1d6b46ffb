"""Cleaning and completing the film catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.text import split_values

MISSING = "N/A"

# Looked-up fields in the order in which a gap is reported.
LOOKUP_FIELDS = (
    "title", "year", "rated", "runtime", "director", "writer", "actors",
    "plot", "language", "country", "awards", "imdb_rating", "imdb_votes",
)


def to_number(c: Column) -> Column:
    """``1,234`` -> 1234.0; ``N/A`` and anything unreadable -> null."""
    plain = F.replace(c.cast("string"), F.lit(","), F.lit(""))
    return F.nullif(plain, F.lit(MISSING)).try_cast("double")


def parse_numeric(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, to_number(F.col(col)))


def certificate(c: Column) -> Column:
    """Upper case; unrated and not rated are one; the dual M/PG becomes M."""
    c = F.upper(c)
    for old, new in (("UNRATED", "NOT RATED"), ("NR", "NOT RATED"), ("M/PG", "M")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalise_certificate(df: DataFrame, col: str = "rated") -> DataFrame:
    return df.withColumn(col, certificate(F.col(col)))


def sorted_list(c: Column, sep: str, trim: bool = False) -> Column:
    joined = F.array_join(F.array_sort(split_values(c, sep, trim)), "|")
    return F.rtrim(joined, F.lit("|"))


def canonical_list(df: DataFrame, col: str, sep: str, trim: bool = False) -> DataFrame:
    """A multi-valued string in alphabetical order, separated by pipes."""
    return df.withColumn(col, sorted_list(F.col(col), sep, trim))


def clean_catalogue(movies: DataFrame) -> DataFrame:
    """All cleaning steps in one projection."""
    lists = {
        "genres": sorted_list(F.col("genres"), "|"),
        **{c: sorted_list(F.col(c), ",", True)
           for c in ("director", "writer", "language", "country")},
    }
    numbers = {c: to_number(F.col(c)) for c in ("imdb_rating", "imdb_votes")}
    steps = {**lists, **numbers, "rated": certificate(F.col("rated"))}
    return movies.withColumns({c: e for c, e in steps.items() if c in movies.columns})


def value_counts(
    df: DataFrame, col: str, sep: str | None = None, trim: bool = False
) -> DataFrame:
    """(value, n) for a plain column, or for the parts of a multi-valued one."""
    value = F.col(col) if sep is None else F.explode(split_values(F.col(col), sep, trim))
    return (
        df.filter(F.col(col).isNotNull())
        .select(value.alias("value"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def override_rows(df: DataFrame, patch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Whole rows of ``patch`` in place of the rows of ``df`` with their key.

    One anti join: a small patch is broadcast by size and ``df`` is not moved.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(patch.select(*keys), keys, "left_anti").unionByName(
        patch, allowMissingColumns=True
    )


def enrich(
    movies: DataFrame, links: DataFrame, records: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(catalogue with the fields of the looked-up records, gaps).

    ``records`` is keyed by imdbId. A field the record lacks keeps its old
    value. Gaps are (imdbId, field): the first missing field of each linked
    film, ``title`` where there is no record.
    """
    found = records.select("imdbId", *[F.col(f).alias(f"_{f}") for f in LOOKUP_FIELDS])
    linked = links.select("movieId", "imdbId").join(found, "imdbId", "left")
    fields = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in LOOKUP_FIELDS}
    filled = (
        movies.join(linked, "movieId", "left").withColumns(fields).select(*movies.columns)
    )
    first = F.coalesce(*[F.when(F.col(f"_{f}").isNull(), F.lit(f)) for f in LOOKUP_FIELDS])
    gaps = linked.select("imdbId", first.alias("field")).filter(F.col("field").isNotNull())
    return filled, gaps
