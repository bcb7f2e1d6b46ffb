"""Exact k-means over integer vectors with heap-ordered bounds.

A vector's gap is by how much the distance to its second nearest centroid
exceeds that to its own. When centroids move, the gap of every vector of a
cluster shrinks by at most the cluster's own drift plus the largest drift of
any other, so the cluster keeps one offset, the sum of these, and its vectors
in order of gap plus the offset at the time the gap was measured. Vectors that
come before the present offset have expired; only they are popped, compared
with all centroids and put back. The rest can't have changed cluster.

Spark keeps the vectors in blocks that are written once, bucketed by block, so
that a round joins them with the small table of heaps without moving them. A
heap is the run of a block's vectors of one cluster in ascending order. Blocks
report only what they moved between clusters; the centroids follow from sums of
whole numbers, which Spark adds up.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.functions.lineage import scratch, scratch_scope
from reelspark.llm.common import cut, setting
from reelspark.llm.topk import integer_vectors

#: Vectors of a block; a task holds a few blocks at a time.
BLOCK = 4096
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
EXACT = 2.0**53
#: Relative error that the bounds allow for.
SLACK = 1e-9

BLOCKS = "block bigint, ids binary, kind string, vectors binary"
STATE = ("block bigint, popped bigint, member binary, cluster binary, due binary, "
         "moved array<struct<cluster:int,n:bigint,total:array<bigint>>>")


def _blocks(width: int, size: int):
    """Batches of (id, v) to rows of up to ``size`` vectors, in the smallest integer type that holds them."""

    def row(first: int, n: int, ids: list[np.ndarray], parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        top = int(max(x.max(initial=0), -(x.min(initial=0) + 1)))
        kind = next((k for k, bits in (("<i2", 15), ("<i4", 31)) if top < 1 << bits), "<i8")
        return pa.record_batch([pa.array([first + n], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                                pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())],
                               names=["block", "ids", "kind", "vectors"])

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        n, held, ids, parts = 0, 0, [], []
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            key = batch.column("id").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(key):
                step = min(size - held, len(key) - at)
                ids.append(key[at:at + step])
                parts.append(x[at:at + step])
                held, at = held + step, at + step
                if held == size:
                    yield row(first, n, ids, parts)
                    n, held, ids, parts = n + 1, 0, [], []
        if held:
            yield row(first, n, ids, parts)

    return run


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _farthest(x: np.ndarray, centre: np.ndarray) -> int:
    """What no squared distance, nor any term of it, can exceed; an error if that needs over 64 bits."""
    far = (_largest(x) + _largest(centre)) ** 2 * max(1, x.shape[1])
    if far >= 1 << 63:
        raise OverflowError("squared distances exceed 64 bits")
    return far


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers; in doubles only where every step stays below 2**53."""
    if _farthest(x, centre) < EXACT:
        a, c = x.astype(np.float64), centre.astype(np.float64)
        return ((a**2).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centre], axis=1)


def measure(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number at ties; gap to the second, rounded down)."""
    d = squared(x, centre)
    near = np.argmin(d, axis=1)
    if len(centre) == 1:
        return near, np.full(len(x), np.inf)
    row = np.arange(len(x))
    own = np.sqrt(d[row, near].astype(np.float64))
    d[row, near] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64))
    return near, second - own - SLACK * (second + own + 1)


class Heaps:
    """A block's vectors in one ascending run of due offsets per cluster."""

    def __init__(self, member: np.ndarray, cluster: np.ndarray, due: np.ndarray):
        order = np.lexsort((due, cluster))
        self.member, self.cluster, self.due = member[order], cluster[order], due[order]

    @classmethod
    def read(cls, member: bytes, cluster: bytes, due: bytes) -> Heaps:
        heaps = cls.__new__(cls)
        heaps.member, heaps.cluster = np.frombuffer(member, "<i4"), np.frombuffer(cluster, "<i4")
        heaps.due = np.frombuffer(due, "<f8")
        return heaps

    def expired(self, offset: np.ndarray) -> np.ndarray:
        """Which entries are due: of every run the front, up to the cluster's offset."""
        out = np.zeros(len(self.member), dtype=bool)
        first = np.searchsorted(self.cluster, np.arange(len(offset) + 1))
        for a, b, least in zip(first, first[1:], offset, strict=False):
            out[a:a + np.searchsorted(self.due[a:b], least, side="right")] = True
        return out


def _moved(x: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
    """By cluster, how many vectors and what sums it gained; only clusters that changed."""
    changed = np.ones(len(x), dtype=bool) if before is None else before != after
    if not changed.any():
        return []
    k = int(max(after.max(), 0 if before is None else before.max())) + 1
    x, after = x[changed].astype(np.int64), after[changed]
    if _largest(x) * len(x) >= 1 << 62:
        raise OverflowError("the sums of a block exceed 64 bits")
    n, total = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    np.add.at(n, after, 1)
    np.add.at(total, after, x)
    if before is not None:
        np.subtract.at(n, before[changed], 1)
        np.subtract.at(total, before[changed], x)
    hit = np.unique(after if before is None else np.concatenate([after, before[changed]]))
    return [{"cluster": int(c), "n": int(n[c]), "total": total[c].tolist()} for c in hit]


def _assign(width: int, centre: np.ndarray, offset: np.ndarray):
    """Rows of a block and, after the first round, its heaps, to the block's next state."""

    kind = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, width).astype(np.int64)
                if row.get("member") is None:
                    place, before, popped = np.arange(len(x)), None, len(x)
                    after, gap = measure(x, centre)
                    heaps = Heaps(place.astype("<i4"), after.astype("<i4"), gap + offset[after])
                    moved = _moved(x, None, after)
                else:
                    old = Heaps.read(row["member"], row["cluster"], row["due"])
                    out = old.expired(offset)
                    place, before, popped = old.member[out], old.cluster[out], int(out.sum())
                    after, gap = measure(x[place], centre)
                    moved = _moved(x[place], before, after)
                    heaps = Heaps(np.concatenate([old.member[~out], place]),
                                  np.concatenate([old.cluster[~out], after.astype("<i4")]),
                                  np.concatenate([old.due[~out], gap + offset[after]]))
                yield pa.record_batch(
                    [pa.array([row["block"]], pa.int64()), pa.array([popped], pa.int64()),
                     pa.array([heaps.member.tobytes()], pa.binary()), pa.array([heaps.cluster.tobytes()], pa.binary()),
                     pa.array([heaps.due.tobytes()], pa.binary()), pa.array([moved], kind)],
                    names=["block", "popped", "member", "cluster", "due", "moved"])

    return run


def _distances(width: int, centre: np.ndarray):
    """(id, cluster, distance) of every vector of the blocks, from their heaps."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, width).astype(np.int64)
                cluster = np.empty(len(x), dtype=np.int32)
                cluster[np.frombuffer(row["member"], "<i4")] = np.frombuffer(row["cluster"], "<i4")
                _farthest(x, centre)
                away = ((x - centre[cluster]) ** 2).sum(axis=1)
                yield pa.record_batch([pa.array(np.frombuffer(row["ids"], "<i8")), pa.array(cluster), pa.array(away)],
                                      names=["id", "cluster", "distance"])

    return run


def _gains(state: DataFrame, k: int, width: int) -> list[tuple[int, list[int]]]:
    """By cluster, the vectors and sums gained in a round: ``k`` rows of whole numbers."""
    wide = T.DecimalType(38, 0)
    rows = state.select(F.explode("moved").alias("m")).groupBy("m.cluster").agg(
        F.sum("m.n").alias("n"),
        F.array(*[F.sum(F.get("m.total", F.lit(i)).cast(wide)) for i in range(width)]).alias("total"))
    out = [(0, [0] * width) for _ in range(k)]
    for r in rows.collect():
        out[r.cluster] = (int(r.n), [int(t) for t in r.total])
    return out


@contextmanager
def _bucketed(blocks: DataFrame):
    """The blocks as a table bucketed by block, for the length of a ``with``; its files go with the open scratch scope."""
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"blocks_{uuid.uuid4().hex}"
    writer = blocks.repartition(parts, "block").write.format("parquet").bucketBy(parts, "block")
    writer.option("path", scratch(spark, "blocks")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def k_means(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, salt: str = "2:", key: str = "vec_id",
    vector: str = "embedding", scale: int = 256, block: int = BLOCK, log: list | None = None,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector.

    Vectors are those of exactly ``width`` components, none null or non-finite,
    as whole numbers floor(scale * x). Centroids start as the ``k`` vectors with
    the smallest sha256 of ``salt`` and key (all, if fewer); each round assigns
    every vector to the nearest, ties to the smaller number, and moves every
    centroid that has vectors to their mean, rounded down; then they are
    assigned once more. ``distance`` is squared, the inertias are its sums over
    the cluster and over all.

    Rows with a null key take no part; repeated rows count each, also as first
    centroids; other columns are not read; an empty table gives no rows. Squared
    distances beyond 64 bits are an error. On the driver are ``k`` centroids,
    their sums and offsets. ``log`` gets, for each pass, the number of vectors
    that were compared with all centroids.
    """
    spark = vectors.sparkSession
    ints = integer_vectors(vectors.filter(F.size(vector) == width), key, vector, scale)
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = ints.orderBy(order, "v").limit(k).collect()  # at most k vectors
    kind = vectors.schema[key].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    centre = np.array([r.v for r in first], dtype=np.int64)
    sums = [(0, [0] * width) for _ in first]
    offset = np.zeros(len(centre))
    found = scratch(spark, "clusters")
    with scratch_scope(spark), setting(spark, BATCH, "16"):
        with setting(spark, BATCH, "4096"):
            made = cut(ints.mapInArrow(_blocks(width, block), BLOCKS))
        with _bucketed(made) as stored:
            state = None
            for turn in range(rounds + 1):
                rows = stored if state is None else stored.join(state.drop("popped", "moved"), "block")
                state = cut(rows.mapInArrow(_assign(width, centre, offset), STATE))
                if log is not None:
                    log.append(state.agg(F.sum("popped")).first()[0])
                if turn == rounds:
                    break
                gains = _gains(state, len(centre), width)
                sums = [(n + m, [s + g for s, g in zip(a, b, strict=True)])
                        for (n, a), (m, b) in zip(sums, gains, strict=True)]
                after = np.array([[s // n for s in a] if n else c.tolist()
                                  for (n, a), c in zip(sums, centre, strict=True)], dtype=np.int64)
                drift = np.sqrt(((after - centre).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
                centre = after
                if len(centre) > 1:
                    top = np.sort(drift)[-2:]
                    offset = offset + drift + np.where(drift == top[1], top[0], top[1])
            rows = stored.join(state.select("block", "member", "cluster"), "block")
            rows.mapInArrow(_distances(width, centre), "id bigint, cluster int, distance bigint").write.parquet(found)
    done = spark.read.parquet(found)
    inertia = {r.cluster: r.d for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in centre.tolist()])
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(centre))])
    return done.select(
        F.col("id").cast(kind).alias(key), "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.get(digest, F.col("cluster")).alias("centroid_sha256"))
