"""Error measures and least squares over log tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row; rows without a prediction are left out."""
    gap = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.filter(~F.isnan(prediction)).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


@dataclass(frozen=True)
class InteractionFit:
    """y = intercept + a*x1 + b*x2 + c*x1*x2."""

    x1: str
    x2: str
    intercept: float
    a: float
    b: float
    c: float
    r2: float


def fit_interaction_ols(df: DataFrame, y: str, x1: str, x2: str) -> InteractionFit:
    data = df.select(
        F.col(y).cast("double").alias("label"),
        F.col(x1).cast("double").alias("x1"),
        F.col(x2).cast("double").alias("x2"),
    ).dropna()
    data = data.withColumn("x12", F.col("x1") * F.col("x2"))
    packed = VectorAssembler(inputCols=["x1", "x2", "x12"], outputCol="features").transform(data)
    model = LinearRegression(solver="normal").fit(packed.select("features", "label"))
    a, b, c = (float(v) for v in model.coefficients)
    return InteractionFit(x1, x2, float(model.intercept), a, b, c, float(model.summary.r2))


def predict_interaction(fit: InteractionFit, scenarios: DataFrame) -> DataFrame:
    """Scenarios with ``predicted``, not below zero."""
    x1, x2 = F.col(fit.x1).cast("double"), F.col(fit.x2).cast("double")
    value = F.lit(fit.intercept) + fit.a * x1 + fit.b * x2 + fit.c * x1 * x2
    return scenarios.withColumn("predicted", F.greatest(F.lit(0.0), value))


def predict_total(fit: InteractionFit, scenarios: DataFrame) -> DataFrame:
    return predict_interaction(fit, scenarios).agg(F.sum("predicted").alias("total"))


def fit_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, r2) of y on x."""
    pair = (F.col(y).cast("double"), F.col(x).cast("double"))
    return df.agg(
        F.regr_slope(*pair).alias("slope"),
        F.regr_intercept(*pair).alias("intercept"),
        F.regr_r2(*pair).alias("r2"),
    )
