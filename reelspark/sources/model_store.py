"""Saving and loading models as folders of JSON lines."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.plans.model import Model, Params, fit

FACTORS = "id BIGINT, features ARRAY<FLOAT>"
RATINGS = "userId BIGINT, movieId BIGINT, rating FLOAT, full_train BOOLEAN"
PREDICTIONS = "userId BIGINT, movieId BIGINT, predictedRating FLOAT"
IDS = "id BIGINT"
TRAIN_USERS, TRAIN_ITEMS = "userId BIGINT", "movieId BIGINT"
#: The column names that tables are stored and worked on with.
NAMES = ("userId", "movieId", "rating")
METADATA = (
    "als_params STRING, userCol STRING, itemCol STRING, ratingCol STRING, "
    "ownership_conversion DOUBLE, update_threshold INT"
)


def _write_metadata(model: Model, path: str, mode: str, names: Sequence[str]) -> None:
    p = model.params
    als = {"rank": p.rank, "maxIter": p.iters, "regParam": p.reg, "seed": p.seed, **p.als}
    spark = model.user_factors.sparkSession
    row = (json.dumps(als | {"blocks": p.blocks}), *names, float(p.ownership), p.threshold)
    spark.createDataFrame([row], METADATA).coalesce(1).write.json(f"{path}/metadata", mode=mode)


def save_model(
    model: Model, path: str, refit: bool = False, with_ratings: bool = False,
    predictions: DataFrame | None = None, mode: str = "errorifexists", names: Sequence[str] = NAMES,
) -> Model:
    """Write both factor tables, the ids the fit has seen, the ids updated since
    and the scalars; the ratings and a table of predictions on request. With
    ``refit`` the model is fitted on its ratings first. ``names`` are the caller's
    names of the user, film and rating columns. Returns the model saved.

    JSON lines leave nulls out, so a rating that is not trained on is written with
    the flag false; a rating without a flag comes from elsewhere.

    The metadata is written last: a folder without it is an unfinished save.
    """
    if refit:
        model = fit(model.ratings, model.params)
    parts = {
        "userFactors": model.user_factors,
        "itemFactors": model.item_factors,
        "updatedUsers": model.updated_users,
        "updatedItems": model.updated_items,
        "trainUsers": model.train_users(),
        "trainItems": model.train_items(),
    }
    if with_ratings:
        flag = F.coalesce(F.col("full_train"), F.lit(False))
        parts["ratings"] = model.ratings.withColumn("full_train", flag)
    if predictions is not None:
        parts["predictions"] = predictions
    for name, part in parts.items():
        part.write.json(f"{path}/{name}", mode=mode)
    _write_metadata(model, path, mode, names)
    return model


EMPTY = object()


def _part(spark: SparkSession, path: str, schema: str, absent=EMPTY) -> DataFrame | None:
    """A typed part of a saved model; an absent one is an empty frame, or ``absent``."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema) if absent is EMPTY else absent


def load_model(spark: SparkSession, path: str) -> Model:
    """Read a model written by ``save_model``. Ratings saved without the flag
    count as trained on."""
    meta = spark.read.schema(METADATA).json(f"{path}/metadata").first()
    als = json.loads(meta["als_params"])
    params = Params(
        rank=als.pop("rank", 10), iters=als.pop("maxIter", 10), reg=als.pop("regParam", 0.1),
        seed=als.pop("seed", 9), blocks=als.pop("blocks", 0), threshold=meta["update_threshold"],
        ownership=meta["ownership_conversion"], als=als,
    )
    trained = F.coalesce(F.col("full_train"), F.lit(True))
    ratings = _part(spark, f"{path}/ratings", RATINGS).withColumn("full_train", F.when(trained, True))
    users = _part(spark, f"{path}/trainUsers", TRAIN_USERS, absent=None)
    items = _part(spark, f"{path}/trainItems", TRAIN_ITEMS, absent=None)
    return Model(
        params,
        spark.read.schema(FACTORS).json(f"{path}/userFactors"),
        spark.read.schema(FACTORS).json(f"{path}/itemFactors"),
        ratings,
        _part(spark, f"{path}/updatedUsers", IDS),
        _part(spark, f"{path}/updatedItems", IDS),
        users, items,
    )


def load_names(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """The names of the user, film and rating columns a model was saved with."""
    meta = spark.read.schema(METADATA).json(f"{path}/metadata").first()
    return meta["userCol"], meta["itemCol"], meta["ratingCol"]


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _part(spark, f"{path}/predictions", PREDICTIONS)

