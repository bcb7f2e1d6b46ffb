"""The factor model and how it is fitted."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.lineage import allow_checkpoints, cut, forget
from reelspark.functions.ordering import order_key
from reelspark.functions.ranking import rank_all
from reelspark.operators import scoring

LARGEST_INT = 2147483647
#: Ratings per block of the solver. The number of blocks decides the first factors,
#: so it follows the ratings and never the cluster.
RATINGS_PER_BLOCK, LEAST_BLOCKS = 1_000_000, 10
#: Ratings of a block that is made, some 12 bytes each. A step of the fit sends every vector
#: to each block with a rating of it, so blocks beyond what the ratings need only make it send more.
MOST_PER_BLOCK = 20_000_000
#: Ratings of a block that one task sorts in memory, where they are held several times over.
MOST_PER_TASK = 5_000_000
#: How the solver keeps what it works on: its blocks of ratings on disk, not in the heap that tasks
#: need; and each iteration's films are checkpointed, after which it drops the shuffles before them.
KEEP = {"checkpointInterval": 1, "intermediateStorageLevel": "DISK_ONLY"}


@dataclass(frozen=True)
class Params:
    """``threshold``: trained profile size beyond which a user or film is not
    solved again online. ``ownership``: the rating owning a film stands for.
    ``blocks``: blocks of the solver on either side; 0 takes ten, or as many as
    hold 5 million ratings each if those are more. The result depends on it, and on nothing of the cluster.
    ``als``: further settings of ``pyspark.ml.recommendation.ALS``."""

    rank: int = 10
    iters: int = 10
    reg: float = 0.1
    seed: int = 9
    threshold: int = 20
    ownership: float = 4.0
    blocks: int = 0
    als: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    """Factor tables (id, features) and the ratings (userId, movieId, rating,
    full_train) they came from; the updated tables hold the ids (id) changed
    since the last full fit."""

    params: Params
    user_factors: DataFrame
    item_factors: DataFrame
    ratings: DataFrame
    updated_users: DataFrame
    updated_items: DataFrame
    known_users: DataFrame | None = None
    known_items: DataFrame | None = None

    def train_users(self) -> DataFrame:
        """(userId) of the users the last full fit has seen: ``known_users`` if it
        is given (a model loaded without its ratings), else from the ratings."""
        if self.known_users is not None:
            return self.known_users
        return self.ratings.filter("full_train").select("userId").distinct()

    def train_items(self) -> DataFrame:
        """(movieId) of the films the last full fit has seen."""
        if self.known_items is not None:
            return self.known_items
        return self.ratings.filter("full_train").select("movieId").distinct()

    def with_(self, **changes) -> Model:
        return replace(self, **changes)


def no_ids(like: DataFrame) -> DataFrame:
    return like.select("id").limit(0)


def _dense(ratings: DataFrame, col: str) -> DataFrame:
    """(col, index): ids numbered from 0, for ids beyond the solver's int range.

    The solver's limit stays: at most 2**31 - 1 distinct ids a side."""
    ids = ratings.select(col).distinct().withColumn("_key", order_key(0, F.col(col)))
    return rank_all(ids, "_key", col, "_rn").select(
        col, (F.col("_rn") - 1).cast("int").alias("_index")
    )


def _exceeds_int(ratings: DataFrame, cols: list[str]) -> set[str]:
    wide = [c for c in cols if isinstance(ratings.schema[c].dataType, T.LongType)]
    if not wide:
        return set()
    top = ratings.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in wide]).first()
    return {c for c in wide if top[c] is not None and top[c] > LARGEST_INT}


def blocks_for(ratings: int) -> int:
    """The solver's blocks on either side for so many ratings."""
    return max(LEAST_BLOCKS, math.ceil(ratings / RATINGS_PER_BLOCK))


def solver_blocks(ratings: int) -> int:
    """``blocks_for``, but no more blocks than the ratings need."""
    return min(blocks_for(ratings), max(LEAST_BLOCKS, math.ceil(ratings / MOST_PER_BLOCK)))


def fit_blocks(ratings: int) -> int:
    """``solver_blocks``, or as many as tasks can hold if those are more."""
    return max(solver_blocks(ratings), math.ceil(ratings / MOST_PER_TASK))


def _fit_factors(ratings: DataFrame, params: Params, **extra) -> tuple[DataFrame, DataFrame]:
    """Alternating least squares with non-negative factors; returns both tables
    under the ids of ``ratings``. They are written, so that nothing reads the fit again and
    what it shuffled can be dropped."""
    spark = ratings.sparkSession
    allow_checkpoints(spark)
    blocks = params.blocks or fit_blocks(ratings.count())
    settings = {"numUserBlocks": blocks, "numItemBlocks": blocks, **KEEP, **params.als, **extra}
    als = ALS(
        rank=params.rank, maxIter=params.iters, regParam=params.reg, seed=params.seed,
        userCol="userId", itemCol="movieId", ratingCol="rating", nonnegative=True, **settings,
    )
    data = ratings.select("userId", "movieId", F.col("rating").cast("float").alias("rating"))
    maps = {c: _dense(ratings, c) for c in _exceeds_int(ratings, ["userId", "movieId"])}
    for col, ids in maps.items():
        data = data.join(ids, col).drop(col).withColumnRenamed("_index", col)
    fitted = als.fit(data)

    def named(factors: DataFrame, col: str) -> DataFrame:
        kind = ratings.schema[col].dataType
        if col in maps:
            ids = maps[col].select(F.col("_index").alias("id"), F.col(col).alias("_id"))
            factors = factors.join(ids, "id").select(F.col("_id").alias("id"), "features")
        return factors.select(F.col("id").cast(kind).alias("id"), "features")

    found = cut(named(fitted.userFactors, "userId")), cut(named(fitted.itemFactors, "movieId"))
    del fitted
    forget(spark)
    return found


def fit(ratings: DataFrame, params: Params = Params()) -> Model:
    """Fit on explicit ratings; every row is flagged as trained on."""
    users, items = _fit_factors(ratings, params)
    trained = ratings.select("userId", "movieId", "rating").withColumn("full_train", F.lit(True))
    return Model(params, users, items, trained, no_ids(users), no_ids(items))


def implicit_labels(ratings: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Ratings as 1 (liked) or 0."""
    liked = (F.col("rating") >= F.lit(threshold)).cast("int")
    return ratings.select("userId", "movieId", liked.alias("rating"))


def fit_implicit(ratings: DataFrame, params: Params = Params(), threshold: float = 4.0) -> Model:
    """Fit on the 0/1 labels as implicit feedback."""
    labels = implicit_labels(ratings, threshold)
    users, items = _fit_factors(labels, params, implicitPrefs=True)
    trained = labels.withColumn("full_train", F.lit(True))
    return Model(params, users, items, trained, no_ids(users), no_ids(items))


def recommend(model: Model, users: DataFrame | None = None, n: int = 20) -> DataFrame:
    """(userId, movieId, predictedRating, position); users without factors get
    no rows. All users when ``users`` is None."""
    return scoring.recommend_top(
        model.user_factors, model.item_factors, model.ratings, model.params.rank, users, n
    )


def predict(model: Model, users: DataFrame) -> DataFrame:
    """Every prediction for the unseen films of the given users."""
    return scoring.predict_unseen(
        model.user_factors, model.item_factors, model.ratings, model.params.rank, users
    )
