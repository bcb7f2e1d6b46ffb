"""Fold-in: new factors for the entities of one side, the other side fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions.grams import solve_prefixes, solve_rows, solve_stats, stats_of_rows
from reelspark.functions.lineage import cut
from reelspark.functions.ranking import SLICE_ROWS, hot_keys, salted_join
from reelspark.functions.vectors import scale
from reelspark.operators.factors import average_factors

SOLVED = "id bigint, features array<float>, direction array<double>"


def solve_side(
    rows: DataFrame,
    factors: DataFrame,
    entity: str,
    other: str,
    rank: int,
    iters: int,
    reg: float,
    min_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """(id, features, direction) for every ``entity`` in ``rows``.

    ``direction`` is set where some rows had no factors on the ``other`` side;
    such a row's vector is its rating times ``direction``.

    An entity is reduced to one statistics vector. Entities with more than
    ``min_rows`` rows are reduced in several tasks first and their partial
    vectors added; pass None where the rows per entity are known to be few.
    """
    known = factors.select(F.col("id").alias(other), "features")
    if min_rows is None:
        return _solve_whole(rows.join(known, other, "left"), entity, rank, iters, reg)
    # A bounded number of rows, see hot_keys. The rows are parted before they
    # are joined, so each is joined once.
    hot = hot_keys(rows, entity, min_rows).select(entity, F.col("hot_slices").alias("_slices"))
    hot = F.broadcast(hot)
    hot_others = hot_keys(rows, other, min_rows)
    usual = salted_join(
        rows.join(hot, entity, "left_anti"), known, other, entity, hot_others, "left"
    )
    large = salted_join(rows.join(hot, entity), known, other, entity, hot_others, "left")
    return _solve_whole(usual, entity, rank, iters, reg).unionByName(
        _solve_sliced(large, entity, other, rank, iters, reg)
    )


def _fields(entity: str) -> list[Column]:
    return [
        F.col(entity).cast("bigint").alias("id"),
        F.col("rating").cast("double").alias("rating"),
        F.col("features"),
    ]


def _solve_whole(joined: DataFrame, entity: str, rank: int, iters: int, reg: float) -> DataFrame:
    """Solve rows that carry their ``features`` (null if unknown)."""
    placed = joined.select(*_fields(entity)).repartition("id").sortWithinPartitions("id")
    return placed.mapInArrow(solve_rows(rank, iters, reg), SOLVED)


def _solve_sliced(
    joined: DataFrame, entity: str, other: str, rank: int, iters: int, reg: float
) -> DataFrame:
    """The same for entities cut into ``_slices``: sum the slices, then solve."""
    at = F.pmod(F.xxhash64(other), F.col("_slices")).alias("_slice")
    pieces = (
        joined.select(*_fields(entity), at)
        .repartition("id", "_slice")
        .drop("_slice")
        .sortWithinPartitions("id")
        .mapInArrow(stats_of_rows(rank), "id bigint, stats array<double>")
    )
    return (
        pieces.repartition("id")
        .sortWithinPartitions("id")
        .mapInArrow(solve_stats(rank, iters, reg), SOLVED)
    )


def proposed_factors(
    rows: DataFrame, factors: DataFrame, solved: DataFrame, entity: str, other: str,
    rank: int, iters: int,
) -> DataFrame:
    """(id, features) proposed by each entity for the ``other`` ids without
    factors. One id may be proposed by many entities."""
    known = factors.select(F.col("id").alias(other))
    missing = rows.join(known, other, "left_anti")
    return _proposals(missing, solved, entity, other, rank, iters)


def _proposals(
    missing: DataFrame, solved: DataFrame, entity: str, other: str, rank: int, iters: int
) -> DataFrame:
    if iters == 0:
        start = F.array_repeat(F.sqrt(F.col("rating").cast("double")).cast("float"), rank)
        return missing.select(F.col(other).alias("id"), start.alias("features"))
    ways = solved.filter(F.col("direction").isNotNull()).select(
        F.col("id").alias(entity), "direction"
    )
    return missing.join(ways, entity).select(
        F.col(other).alias("id"),
        scale(F.col("direction"), F.col("rating").cast("double")).alias("features"),
    )


def fold_in_users(
    rows: DataFrame, item_factors: DataFrame, rank: int, iters: int = 10, reg: float = 0.1,
    min_rows: int | None = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(user factors, proposed film factors) from (userId, movieId, rating)."""
    solved = solve_side(rows, item_factors, "userId", "movieId", rank, iters, reg, min_rows)
    proposed = proposed_factors(rows, item_factors, solved, "userId", "movieId", rank, iters)
    return solved.select("id", "features"), proposed


def fold_in_items(
    rows: DataFrame, user_factors: DataFrame, rank: int, iters: int = 10, reg: float = 0.1,
    min_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Film factors from (userId, movieId, rating). Users without factors take
    part in the solve; what is found for them is dropped."""
    solved = solve_side(rows, user_factors, "movieId", "userId", rank, iters, reg, min_rows)
    return solved.select("id", "features")


def create_missing(
    train: DataFrame, item_factors: DataFrame, rank: int, iters: int, reg: float
) -> DataFrame | None:
    """Factors for the films in ``train`` that have none: (id, features, step).

    A film is solved in the first step whose prefixes hold it, by the users who
    hold it there, and stays fixed. Only the rows of users who meet such a film
    take part; each step writes the films it creates.
    """
    known = item_factors.select(F.col("id").alias("movieId"), "features")
    unknown = cut(
        train.join(known, "movieId", "left_anti").select("userId", "movieId", "rating", "rn")
    )
    first = unknown.groupBy("movieId").agg(F.min("rn").alias("step"))
    fresh = unknown.join(first, "movieId").filter(F.col("step") == F.col("rn"))
    steps = sorted(s["step"] for s in first.select("step").distinct().collect())  # at most M
    if not steps:
        return None
    fresh = cut(fresh)
    affected = cut(
        train.join(fresh.select("userId").distinct(), "userId", "left_semi")
        .join(known, "movieId", "left")
        .select("userId", "movieId", "rating", "rn", "features")
    )
    created = None
    for step in steps:
        here = fresh.filter(F.col("step") == step)
        rows = affected.filter(F.col("rn") <= step).join(
            here.select("userId"), "userId", "left_semi"
        )
        if created is not None:
            made = created.select(F.col("id").alias("movieId"), F.col("features").alias("_made"))
            rows = rows.join(made, "movieId", "left").withColumn(
                "features", F.coalesce("features", "_made")
            )
        solved = _solve_whole(rows, "userId", rank, iters, reg)
        proposed = _proposals(here, solved, "userId", "movieId", rank, iters)
        new = cut(average_factors(proposed, rank).withColumn("step", F.lit(step)))
        created = new if created is None else created.unionByName(new)
    return created


def prefix_solve(
    train: DataFrame, item_factors: DataFrame, most: int, rank: int,
    iters: int = 10, reg: float = 0.1,
) -> DataFrame:
    """(j, userId, features): every user solved from their first j train rows,
    for each j up to the size of their train set (at most ``most``).

    ``train`` is (userId, movieId, rating, rn) with rn = 1, 2, ... per user.
    One pass over the rows emits all j.
    """
    created = create_missing(train, item_factors, rank, iters, reg)
    have = item_factors.select("id", "features", F.lit(None).cast("bigint").alias("step"))
    if created is not None:
        have = have.unionByName(created.select("id", "features", "step"))
    have = have.withColumnRenamed("id", "movieId")
    rows = train.join(have, "movieId").select(
        F.col("userId").cast("bigint").alias("id"),
        F.col("rn").cast("int").alias("rn"),
        F.col("rating").cast("double").alias("rating"),
        "features",
        F.coalesce(F.col("step") == F.col("rn"), F.lit(False)).alias("fresh"),
    )
    return (
        rows.repartition("id")
        .sortWithinPartitions("id", "rn")
        .mapInArrow(
            solve_prefixes(rank, most, iters, reg),
            "j int, userId bigint, features array<float>",
        )
    )
