"""A table of ratings that is kept by user and by film, so that a batch reads what it touches.

Every part of the store holds its rows twice: by user and, as an index, by film,
in folders by bucket, a hash of the id. A batch adds a delta, the new rows and
the pairs that are gone, also by both; whoever reads a bucket merges its deltas.
``compact`` writes whole parts again when the deltas have become many.

A manifest lists the parts that make up the table. Manifests are numbered and
appear at once and complete under their number, or not at all: a writer that
ends before leaves parts that no manifest names, and of two writers that start
from the same manifest one finds its number taken.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.sources import manifests
from reelspark.sources.manifests import ConcurrentUpdate, files

__all__ = ["ConcurrentUpdate", "Manifest", "RatingsStore"]

KEY = ["userId", "movieId"]
SCHEMA = "userId BIGINT, movieId BIGINT, rating FLOAT, full_train BOOLEAN, gone BOOLEAN, bucket INT"
SIDES = {"userId": "by_user", "movieId": "by_film"}
#: Rows of a bucket aimed at, and of a file of a bucket at most, about.
BUCKET_ROWS, FILE_ROWS = 1_000_000, 5_000_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 4096
#: Deltas, and their share of the rows, beyond which ``compact`` writes whole parts.
MOST_DELTAS, MOST_SHARE = 16, 0.2


@dataclass(frozen=True)
class Manifest:
    number: int
    buckets: int
    base: str
    rows: int
    deltas: tuple[str, ...] = ()
    delta_rows: int = 0


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(buckets)).cast("int")


class RatingsStore:
    """The store at ``path`` as its manifest describes it; ``latest`` reads the newest manifest."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    @classmethod
    def create(cls, ratings: DataFrame, path: str, buckets: int | None = None) -> RatingsStore:
        """A store of ``ratings`` (userId, movieId, rating, full_train), one row per user and film."""
        spark = ratings.sparkSession
        rows = ratings.count()
        buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(rows / BUCKET_ROWS)))
        store = cls(spark, path, Manifest(-1, buckets, "", rows))
        base = store._write("base", ratings.withColumn("gone", F.lit(False)))
        return store._commit(replace(store.manifest, base=base))

    @classmethod
    def latest(cls, spark: SparkSession, path: str) -> RatingsStore:
        number, fields = manifests.latest(spark, path.rstrip("/"))
        return cls(spark, path, Manifest(**fields | {"number": number, "deltas": tuple(fields["deltas"])}))

    def _write(self, kind: str, rows: DataFrame) -> str:
        """Write a part in both orders; a bucket with very many rows is dealt to several tasks and files."""
        name = f"{kind}-{uuid.uuid4().hex}"
        rows = rows.select(
            F.col("userId").cast("bigint").alias("userId"), F.col("movieId").cast("bigint").alias("movieId"),
            F.col("rating").cast("float").alias("rating"), F.col("full_train").cast("boolean").alias("full_train"), "gone")
        for key, folder in SIDES.items():
            other = KEY[1 - KEY.index(key)]
            dealt = rows.withColumn("bucket", bucket_of(F.col(key), self.manifest.buckets))
            sizes = dealt.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILE_ROWS)).alias("files"))
            salted = dealt.join(F.broadcast(sizes), "bucket").withColumn(  # a row per bucket
                "salt", F.pmod(F.xxhash64(other), F.col("files")))
            salted.repartition("bucket", "salt").sortWithinPartitions("bucket", key).select(
                *[c for c in rows.columns], "bucket").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{self.path}/{name}/{folder}")
        return name

    def _commit(self, manifest: Manifest) -> RatingsStore:
        """Let the manifest appear under the next number; an error if another writer took it."""
        number = self.manifest.number + 1
        manifests.commit(self.spark, self.path, number, {k: v for k, v in vars(manifest).items() if k != "number"})
        return RatingsStore(self.spark, self.path, replace(manifest, number=number))

    def _read(self, part: str, side: str, buckets: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{part}/{SIDES[side]}")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _merged(self, side: str, ids: DataFrame | None) -> DataFrame:
        """Rows of the given ids (column ``side``), or all: the newest of each key, without those that are gone."""
        buckets = None
        if ids is not None:
            ids = ids.select(F.col(side).cast("bigint").alias(side)).distinct()
            found = ids.select(bucket_of(F.col(side), self.manifest.buckets).alias("b")).distinct()
            buckets = sorted(r.b for r in found.collect())  # as many numbers as the store has buckets, at most

        def own(part: str) -> DataFrame:
            rows = self._read(part, side, buckets).drop("bucket")
            return rows if ids is None else rows.join(ids, side, "left_semi")

        base = own(self.manifest.base).drop("gone")
        if not self.manifest.deltas:
            return base
        later = None
        for n, part in enumerate(self.manifest.deltas):
            rows = own(part).withColumn("n", F.lit(n))
            later = rows if later is None else later.unionByName(rows)
        last = W.partitionBy(*KEY).orderBy(F.desc("n"))
        newest = later.withColumn("k", F.row_number().over(last)).filter("k = 1")
        kept = base.join(newest.select(*KEY), KEY, "left_anti")
        return kept.unionByName(newest.filter("not gone").select(*base.columns))

    def rows(self) -> DataFrame:
        """(userId, movieId, rating, full_train) of the whole table."""
        return self._merged("userId", None)

    def of_users(self, ids: DataFrame) -> DataFrame:
        """The rows of the given users (userId), from their buckets alone."""
        return self._merged("userId", ids)

    def of_films(self, ids: DataFrame) -> DataFrame:
        """The rows of the given films (movieId), from their buckets of the index alone."""
        return self._merged("movieId", ids)

    def touched(self, batch: DataFrame) -> DataFrame:
        """The ratings that share a user or a film with the batch."""
        users = batch.select(F.col("userId").cast("bigint").alias("userId")).distinct()
        others = self.of_films(batch).join(users, "userId", "left_anti")
        return self.of_users(users).unionByName(others)

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> RatingsStore:
        """The store after a delta: rows to put in place of those of their keys, pairs to take out.

        Raises ``ConcurrentUpdate``, and changes nothing, if another writer was
        first. Keys must not repeat within ``changed`` nor be in both.
        """
        rows = changed.select(*KEY, "rating", "full_train").withColumn("gone", F.lit(False))
        if removed is not None:
            nothing = F.lit(None)
            rows = rows.unionByName(removed.select(*KEY).distinct().select(
                *KEY, nothing.cast("float").alias("rating"), nothing.cast("boolean").alias("full_train"), F.lit(True).alias("gone")))
        delta = self._write("delta", rows)
        written = self._read(delta, "userId", None).count()
        if not written:
            return self
        return self._commit(replace(
            self.manifest, deltas=(*self.manifest.deltas, delta), delta_rows=self.manifest.delta_rows + written))

    def due(self) -> bool:
        """Whether the deltas have become many, by their number or their rows."""
        m = self.manifest
        return len(m.deltas) > MOST_DELTAS or m.delta_rows > MOST_SHARE * max(1, m.rows)

    def compact(self, force: bool = False) -> RatingsStore:
        """The store with whole parts written again, if it is ``due`` or ``force`` says so.

        Older parts stay for readers of older manifests; ``clean`` deletes them.
        """
        if not self.manifest.deltas or not (force or self.due()):
            return self
        base = self._write("base", self.rows().withColumn("gone", F.lit(False)))
        rows = self._read(base, "userId", None).count()
        return self._commit(replace(self.manifest, base=base, rows=rows, deltas=(), delta_rows=0))

    def clean(self) -> list[str]:
        """Delete the parts that this manifest doesn't name; for times without other writers or readers."""
        fs, jvm = files(self.spark, self.path)
        named = {self.manifest.base, *self.manifest.deltas, "manifests"}
        gone = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return [p.getName() for p in gone]

