"""Applying a stream of ratings to a saved model.

A model lives in a folder of versions. The first holds whole tables, every
later one only what a micro-batch changed: factors solved again, ratings of the
batch, pairs removed. Reading takes the newest row of each key, so a micro-batch
costs what it touches; ``compact`` writes whole tables again from time to time.

A version's name is the next free number, and its last file names the stream and
the micro-batch it came from. A micro-batch that is run again after a failure
finds its version complete and does nothing; one of a new stream, whose numbers
start at 0 again, gets a version of its own.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspark.functions.lineage import scratch_scope
from reelspark.operators.ratings import KEY
from reelspark.plans.incremental import Changes, apply_changes, changes
from reelspark.plans.model import Model
from reelspark.sources.model_store import FACTORS, load_model, save_model

RATINGS = "userId BIGINT, movieId BIGINT, rating FLOAT, full_train BOOLEAN"
DONE = "done STRING"


def version_path(root: str, number: int) -> str:
    return f"{root}/version={number}"


def _complete(spark: SparkSession, root: str) -> DataFrame | None:
    """(version, done) of the complete versions: that file is written last."""
    try:
        return spark.read.schema(DONE).option("basePath", root).json(f"{root}/version=*/done")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def versions(spark: SparkSession, root: str) -> dict[int, dict]:
    """What the complete versions came from, by number; whole ones have ``whole``."""
    found = _complete(spark, root)
    rows = [] if found is None else found.select(F.col("version").cast("int"), "done").collect()
    return {r.version: json.loads(r.done) for r in sorted(rows)}


def _finish(spark: SparkSession, path: str, **origin) -> None:
    done = spark.createDataFrame([(json.dumps(origin),)], DONE)
    done.coalesce(1).write.mode("overwrite").json(f"{path}/done")


def start_model(model: Model, root: str) -> None:
    """Save the model a stream starts from, as whole tables."""
    spark = model.user_factors.sparkSession
    path = version_path(root, max(versions(spark, root), default=-1) + 1)
    save_model(model, path, with_ratings=True, mode="overwrite")
    _finish(spark, path, whole=True)


def _newest(spark: SparkSession, root: str, numbers: list[int], name: str, schema: str, keys: list[str]) -> DataFrame:
    """Of the rows that some versions hold, the newest of each key."""
    paths = [f"{version_path(root, n)}/{name}" for n in numbers]
    rows = spark.read.schema(schema).option("basePath", root).json(paths)
    last = W.partitionBy(*keys).orderBy(F.desc(F.col("version").cast("int")))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "version")


def load_current(spark: SparkSession, root: str) -> Model:
    """The model as the newest complete version leaves it."""
    known = versions(spark, root)
    base = max((n for n, origin in known.items() if origin.get("whole")), default=None)
    if base is None:
        raise ValueError(f"{root}: no model there; start_model saves one")
    model = load_model(spark, version_path(root, base))
    later = [n for n in known if n > base]
    if not later:
        return model
    ratings = _newest(spark, root, later, "ratings", RATINGS + ", gone BOOLEAN", KEY)
    trained = F.when(F.col("full_train"), True)
    return apply_changes(model, Changes(
        _newest(spark, root, later, "userFactors", FACTORS, ["id"]),
        _newest(spark, root, later, "itemFactors", FACTORS, ["id"]),
        ratings.filter("not gone").withColumn("full_train", trained).drop("gone"),
        ratings.filter("gone").select(*KEY),
    ))


def compact(spark: SparkSession, root: str) -> None:
    """Write the current model as whole tables, in a version of its own."""
    start_model(load_current(spark, root), root)


def apply_to_saved(root: str, kind: str = "rate", stream: str | None = None):
    """The function for ``foreachBatch``. ``stream`` names the stream; by default
    it is the query's own id, which its checkpoint keeps."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        known = versions(spark, root)
        if any((o.get("stream"), o.get("batch")) == (name, number) for o in known.values()):
            return
        with scratch_scope(spark):
            made = changes(load_current(spark, root), batch, kind)
            path = version_path(root, max(known) + 1)
            none = F.lit(None)
            removed = made.removed.select(
                *KEY, none.cast("float").alias("rating"), none.cast("boolean").alias("full_train"),
                F.lit(True).alias("gone"))
            kept = made.ratings.select(*KEY, "rating", "full_train", F.lit(False).alias("gone"))
            # An unfinished version of an earlier attempt is replaced.
            for part, rows in (("userFactors", made.user_factors), ("itemFactors", made.item_factors),
                               ("ratings", kept.unionByName(removed))):
                rows.write.mode("overwrite").json(f"{path}/{part}")
        _finish(spark, path, stream=name, batch=number)

    return run


def start_updates(
    stream: DataFrame, root: str, checkpoint: str, kind: str = "rate", **trigger
) -> StreamingQuery:
    """Apply every micro-batch of (userId, movieId, rating) to the model at
    ``root``."""
    writer = stream.writeStream.foreachBatch(apply_to_saved(root, kind))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()
