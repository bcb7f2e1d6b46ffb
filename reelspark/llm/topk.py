"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are grouped by their nearest pivot. A group's summary (its size, its
radius, its largest norm) bounds the inner product a query can reach in it.
Every query is first solved in its own group, which gives a score that its
k-th best cannot fall below, and then sent to just those groups whose bound
reaches that score. The queries travel, not the data, since they are fewer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.llm.common import cut, share

#: Pivots at least and at most; between, the root of the number of vectors. The
#: table of summaries and the pivots themselves are this many rows.
PIVOTS, MOST_PIVOTS = 128, 1024
#: Vectors and queries that meet in one place at most (on average, by a hash).
DATA_TILE, QUERY_TILE = 16_384, 4_096
EXACT = 2.0**53
RESULT = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int = 256, *others: Column) -> DataFrame:
    """(id, v, *others): floor(scale * x) of every vector without null or non-finite components."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return vectors.filter(x.isNotNull() & F.col(key).isNotNull()).filter(finite).select(
        F.col(key).cast("bigint").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"), *others,
    )


def _matrix(column, width: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(ends)
    out = np.zeros((len(size), width), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; in doubles only where they stay below 2**53."""
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.array([[sum(map(int.__mul__, a, b)) for b in x.tolist()] for a in q.tolist()], dtype=np.int64).reshape(
        len(q), len(x))


def _solve(k: int, width: int, exact: bool):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        parts = []
        if len(queries) and len(data):
            ids = data["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x = _matrix(data["v"].combine_chunks(), width)[order]
            qid = queries["id"].to_numpy()
            q = _matrix(queries["v"].combine_chunks(), width)
            step = max(1, (4 << 20) // max(1, len(ids)))
            for at in range(0, len(qid), step):
                score = _scores(q[at:at + step], x, exact)
                own = qid[at:at + step, None] == ids[None, :]
                low = np.iinfo(np.int64).min
                score = np.where(own, low, score)
                # The k best and all that tie with the last of them, smaller ids first.
                if len(ids) > k:
                    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    row, col = np.nonzero((score >= least[:, None]) & ~own)
                else:
                    row, col = np.nonzero(~own)
                value = score[row, col]
                best = np.lexsort((col, -value, row))
                row, col, value = row[best], col[best], value[best]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                keep = nth < k
                parts.append((qid[at:at + step][row[keep]], ids[col[keep]], value[keep]))
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table(joined, names=["query_id", "vec_id", "score"])

    return run


def _of(counts: dict[int, int]) -> Column:
    """The number of the row's cell."""
    return F.element_at(F.create_map(*[F.lit(x) for c in sorted(counts) for x in (c, counts[c])]), F.col("cell"))


def _asked(queries: DataFrame) -> dict[int, int]:
    """Blocks of queries that stand with each cell; a row per pivot at most."""
    return {r.cell: math.ceil(r.n / QUERY_TILE) for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _local(queries: DataFrame, data: DataFrame, tiles: dict[int, int], k: int, width: int, exact: bool):
    """The best k of each query among the data of the groups it was sent to.

    A group's vectors are dealt to tiles and the queries that stand with it to
    blocks. A vector goes once to each block of its own group, and nowhere if no
    query asks for the group.
    """
    blocks = _asked(queries)
    if not blocks:
        return data.sparkSession.createDataFrame([], RESULT)

    left = queries.withColumn("tile", F.explode(F.sequence(F.lit(0), _of(tiles) - 1))).withColumn(
        "block", F.pmod(F.xxhash64("id"), _of(blocks)).cast("int"))
    right = copies(data, tiles, blocks)
    on = ["cell", "tile", "block"]
    return left.select("id", "v", *on).groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(
        _solve(k, width, exact), RESULT)


def copies(data: DataFrame, tiles: dict[int, int], blocks: dict[int, int]) -> DataFrame:
    """(cell, id, v, tile, block): the vectors of the cells asked for, once for each block of queries there."""
    return data.filter(F.col("cell").isin(sorted(blocks))).select(
        "cell", "id", "v", F.pmod(F.xxhash64("id"), _of(tiles)).cast("int").alias("tile"),
        F.explode(F.sequence(F.lit(0), _of(blocks) - 1)).alias("block"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256, pivots: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    ``is_query`` makes a condition of the key. Candidates are all rows but those
    with the query's own key; ties go to the smaller key. A query with fewer
    than ``k`` candidates gets all. Vectors that are null or hold a null or
    non-finite component take no part; shorter vectors count as padded with
    zeros; an inner product beyond 64 bits is an error. Keys are expected to be
    unique: of repeated rows each counts as a candidate, and as a query the
    result holds the key's ``k`` best over its rows. Rows with a null key take
    no part, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ints = cut(integer_vectors(vectors, key, vector, scale))
    width, largest, rows_n, queries_n = ints.agg(
        F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))),
        F.count(F.lit(1)), F.count_if(is_query(F.col("id"))),
    ).first()
    if not queries_n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    exact = int(largest or 0) ** 2 * max(1, width) < EXACT
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows_n)))
    first = ints.orderBy(share(F.col("id")), "id").limit(pivots).collect()  # at most `pivots` vectors
    centre = np.zeros((len(first), width))
    for i, row in enumerate(first):
        centre[i, :len(row.v)] = row.v

    def group(batches):
        half = (centre**2).sum(axis=1) / 2
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            cell = np.argmax(x @ centre.T - half, axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            away = np.sqrt(((x - centre[cell]) ** 2).sum(axis=1))
            norm = np.sqrt((x**2).sum(axis=1))
            yield pa.record_batch(
                [pa.array(cell), batch.column("id"), batch.column("v"), pa.array(away), pa.array(norm)],
                names=["cell", "id", "v", "away", "norm"])

    grouped = cut(ints.mapInArrow(group, "cell int, id bigint, v array<bigint>, away double, norm double"))
    summary = grouped.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")
    ).collect()  # one row per pivot at most
    tiles = {r.cell: math.ceil(r.n / DATA_TILE) for r in summary}
    queries = cut(grouped.filter(is_query(F.col("id"))).select("id", "v", "cell"))
    home = cut(_best(_local(queries, grouped, tiles, k, width, exact), k))
    floor = home.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    cells = np.array([r.cell for r in summary], dtype=np.int32)
    radius, norm = (np.array([r[c] for r in summary]) for c in ("radius", "norm"))

    def send(batches):
        for batch in batches:
            q = _matrix(batch.column("v"), width).astype(np.float64)
            size = np.sqrt((q**2).sum(axis=1))[:, None]
            reach = np.minimum(q @ centre[cells].T + size * radius, size * norm)
            reach = reach + 1e-9 * (1 + size * (norm + radius))  # for rounding
            least = batch.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.where(np.isnan(least), -np.inf, least)
            other = cells[None, :] != batch.column("cell").to_numpy()[:, None]
            row, col = np.nonzero((reach >= least[:, None]) & other)
            yield pa.record_batch(
                [batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cells[col])],
                names=["id", "v", "cell"])

    asking = queries.join(floor, queries.id == floor.query_id, "left").select("id", "v", "cell", "floor")
    away = cut(asking.mapInArrow(send, "id bigint, v array<bigint>, cell int"))
    far = _local(away, grouped, tiles, k, width, exact)
    return _best(home.select("query_id", "vec_id", "score").union(far), k).select(
        "query_id", "rank", "vec_id", "score")

