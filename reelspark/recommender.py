"""One object for the life of a model: fit, recommend, update, evaluate, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.plans import evaluation, model
from reelspark.plans.incremental import apply_batch
from reelspark.plans.model import Model, Params
from reelspark.sources import model_store


class Recommender:
    """Holds the current ``Model``. Every argument and result is a DataFrame.

    ``userCol``, ``itemCol`` and ``ratingCol`` are the caller's column names;
    they are renamed on the way in and out. ``als`` are settings of
    ``pyspark.ml.recommendation.ALS`` (rank, maxIter, regParam, seed, ...).
    """

    def __init__(
        self, userCol: str = "userId", itemCol: str = "movieId", ratingCol: str = "rating",
        update_threshold: int = 20, ownership_conversion: float = 4.0, **als,
    ) -> None:
        self.names = {userCol: "userId", itemCol: "movieId", ratingCol: "rating"}
        self.params = Params(
            rank=als.pop("rank", 10), iters=als.pop("maxIter", 10), reg=als.pop("regParam", 0.1),
            seed=als.pop("seed", 9), threshold=update_threshold, ownership=ownership_conversion,
            als=als,
        )
        self._model: Model | None = None

    @property
    def model(self) -> Model:
        if self._model is None:
            raise ValueError("fit or load a model first")
        return self._model

    def _in(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(self.names)

    def _out(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({v: k for k, v in self.names.items()})

    def fit(self, train: DataFrame | None = None) -> Recommender:
        """Fit on ``train``, or again on the current ratings."""
        ratings = self.model.ratings if train is None else self._in(train)
        self._model = model.fit(ratings, self.params)
        return self

    def recommend(self, users: DataFrame | None = None, num_recs: int = 20) -> DataFrame:
        """The best unseen films of the given users (all if None). Computed from
        the current factors, so updates show at once."""
        users = None if users is None else self._in(users)
        return self._out(model.recommend(self.model, users, num_recs))

    def predict(self, users: DataFrame) -> DataFrame:
        """Every prediction for the unseen films of the given users."""
        return self._out(model.predict(self.model, self._in(users)))

    def _apply(self, batch: DataFrame, kind: str) -> None:
        self._model = apply_batch(self.model, self._in(batch), kind)

    def add_ratings(self, ratings: DataFrame) -> None:
        """Add or replace ratings and update the factors they touch."""
        self._apply(ratings, "rate")

    def add_to_collection(self, pairs: DataFrame) -> None:
        """Films a user owns without having rated them."""
        self._apply(pairs, "own")

    def remove_ratings(self, pairs: DataFrame) -> None:
        self._apply(pairs, "remove")

    def evaluate(self, test: DataFrame, alpha: float = 0.9) -> DataFrame:
        """Error curve, elbow and adjusted RMSE on users not trained on."""
        return evaluation.evaluate(self.model, self._in(test), alpha)

    def evaluate_without_ratings(self, test: DataFrame, alpha: float = 0.9) -> DataFrame:
        return evaluation.evaluate_ownership(self.model, self._in(test), alpha)

    def save(
        self, path: str, refit: bool = False, save_ratings: bool = False,
        predictions: DataFrame | None = None,
    ) -> None:
        predictions = None if predictions is None else self._in(predictions)
        self._model = model_store.save_model(
            self.model, path, refit, save_ratings, predictions, names=list(self.names))

    def load(self, spark: SparkSession, path: str) -> Recommender:
        """Take over a saved model, its settings and its column names."""
        self._model = model_store.load_model(spark, path)
        self.names = dict(zip(model_store.load_names(spark, path), model_store.NAMES))
        self.params = self._model.params
        return self
