"""Hard negatives by angular triangle filtering.

For every vector the angles to some reference directions are stored, and its
norm. The angle between two vectors lies between the difference and the sum of
their angles to any reference; the cosines of those ends, times the norms, bound
the inner product. The bounds are taken for whole groups of vectors, which
decides where an anchor is sent, and then for short runs of vectors in the order
of their angles: only where the interval of possible scores meets a window that
is asked for, and can still beat what was found, are whole numbers multiplied.

A search has up to as many windows of scores per anchor as it has positives: the
positives are the best of one window without ends among the anchor's own label,
the negatives the best of a window below each positive among the others. Both
are solved first in the anchor's own group, whose results bound what the other
groups must reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspark.functions.lineage import scratch, scratch_scope
from reelspark.llm.common import cut, share
from reelspark.llm.topk import EXACT, _matrix, integer_vectors

#: Reference directions, and with them groups: one per so many vectors, within these bounds.
GROUP_ROWS, LEAST_GROUPS, MOST_GROUPS = 16_384, 8, 32
#: Vectors and anchors that meet in one place at most (on average, by a hash).
DATA_TILE, ANCHOR_TILE = 16_384, 16_384
#: Vectors of a run that is bounded at once, and anchors scored at a time.
RUN, STRIP = 128, 2048
#: Radians that the stored angles, 32-bit numbers, may be off, and the relative error of the bounds.
ANGLE_SLACK, SLACK = 2e-6, 1e-9
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "row bigint, slot int, vec_id bigint, score bigint"
WINDOWS = "array<struct<slot:int,low:bigint,high:bigint,floor:bigint>>"


def angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to the unit vectors ``refs``); a zero vector is at angle zero."""
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    theta = np.arccos(np.clip(unit @ refs.T, -1, 1))
    theta[norm == 0] = 0
    return norm, theta


def intervals(norm, theta, near, far, least, most) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of vectors with those of groups.

    ``norm`` and ``theta`` (by reference) are of the vectors; of each group come
    the smallest and largest angle to each reference and the ends of its norms.
    """
    low, high = np.zeros((len(norm), len(least))), np.full((len(norm), len(least)), math.pi)
    for r in range(theta.shape[1]):
        t = theta[:, r][:, None]
        low = np.maximum(low, np.maximum(near[:, r] - t, t - far[:, r]))
        high = np.minimum(high, np.minimum(t + far[:, r], 2 * math.pi - t - near[:, r]))
    best = np.cos(np.maximum(0, low - ANGLE_SLACK))
    worst = np.cos(np.minimum(math.pi, high + ANGLE_SLACK))
    size = norm[:, None]
    upper = size * np.where(best > 0, most, least) * best
    lower = size * np.where(worst > 0, least, most) * worst
    give = SLACK * (size * most + 1)
    return lower - give, upper + give


class Anchors:
    """Anchors and their windows as arrays of equal length; a window that an anchor lacks is empty."""

    def __init__(self, table: pa.Table | pa.RecordBatch, refs: np.ndarray):
        table = pa.table(table) if isinstance(table, pa.Table) else pa.Table.from_batches([table])
        self.row, self.id = table["row"].to_numpy(), table["id"].to_numpy()
        self.label = table["label"].to_numpy()
        self.v = _matrix(table["v"].combine_chunks(), refs.shape[1])
        self.norm, self.theta = angles(self.v, refs)
        asked = table["windows"].combine_chunks()
        many = asked.value_lengths().to_numpy()
        at = np.repeat(np.arange(len(many)), many), np.concatenate([np.zeros(0, np.int64), *map(np.arange, many)])
        flat = asked.flatten()
        shape = len(many), max(1, int(many.max(initial=0)))
        self.slot, self.low, self.high, self.floor = (np.full(shape, x) for x in (0, HIGH, LOW, LOW))
        for name in ("slot", "low", "high", "floor"):
            getattr(self, name)[at] = flat.field(name).to_numpy()

    def asks(self, lower: np.ndarray, upper: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """By anchor (row) and group (column), whether the interval meets a window and reaches its floor."""
        out = np.zeros(lower.shape, dtype=bool)
        for low, high, least in zip(self.low.T, self.high.T, floor.T, strict=True):
            bottom, top = np.maximum(low, least).astype(np.float64), high.astype(np.float64)
            out |= (low <= high)[:, None] & (upper >= bottom[:, None]) & (lower <= top[:, None])
        return out


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; in doubles only where they stay below 2**53."""
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.array([[sum(map(int.__mul__, a, b)) for b in x.tolist()] for a in q.tolist()], dtype=np.int64).reshape(
        len(q), len(x))


class Data:
    """The vectors of a place in runs: by label, then by the angle to the reference they are nearest to."""

    def __init__(self, table: pa.Table, refs: np.ndarray):
        label = table["label"].to_numpy()
        theta = table["angles"].combine_chunks().flatten().to_numpy().reshape(len(label), len(refs)).astype(np.float64)
        order = np.lexsort((theta[:, np.argmin(theta.mean(axis=0))], label))
        self.label, theta, self.id = label[order], theta[order], table["id"].to_numpy()[order]
        self.v = _matrix(table["v"].combine_chunks(), refs.shape[1])[order]
        norm = table["norm"].to_numpy()[order]
        self.first = np.arange(0, len(order), RUN)
        self.last = np.append(self.first[1:], len(order))
        ends = [f.reduceat(theta, self.first, axis=0) for f in (np.minimum, np.maximum)]
        self.summary = *ends, *(f.reduceat(norm, self.first) for f in (np.minimum, np.maximum))


def _best_of(a: Anchors, data: Data, same: bool, k: int, exact: bool) -> tuple[np.ndarray, ...]:
    """The ``k`` best of every window among ``data``, as (row, slot, vec_id, score).

    Runs are taken by descending bound; the worst of the ``k`` found so far is
    what a later run must reach.
    """
    lower, upper = intervals(a.norm, a.theta, *data.summary)
    shape = *a.low.shape, k
    best, name = np.full(shape, LOW), np.full(shape, HIGH)
    floor = a.floor.copy()
    for j in np.argsort(-upper.mean(axis=0), kind="stable"):
        run = slice(data.first[j], data.last[j])
        label, ids = data.label[run], data.id[run]
        if same:
            possible = (a.label >= label[0]) & (a.label <= label[-1])
        else:
            possible = (a.label != label[0]) | (a.label != label[-1])
        at = np.flatnonzero(possible & a.asks(lower[:, [j]], upper[:, [j]], floor)[:, 0])
        if not len(at):
            continue
        score = _products(a.v[at], data.v[run], exact)
        fits = (a.id[at][:, None] != ids) & ((a.label[at][:, None] == label) == same)
        for s in range(shape[1]):
            low, high = np.maximum(a.low[at, s], floor[at, s]), a.high[at, s]
            r, c = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
            hit = np.unique(r)
            who = np.concatenate([r, np.repeat(hit, k)])
            value = np.concatenate([score[r, c], best[at[hit], s].ravel()])
            named = np.concatenate([ids[c], name[at[hit], s].ravel()])
            order = np.lexsort((named, ~value, who))  # ~ turns the order around, whatever the size
            who, value, named = who[order], value[order], named[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            top = nth < k
            best[at[who[top]], s, nth[top]], name[at[who[top]], s, nth[top]] = value[top], named[top]
            floor[at[hit], s] = np.maximum(floor[at[hit], s], best[at[hit], s, k - 1])
    r, s, n = np.nonzero(best > LOW)
    return a.row[r], a.slot[r, s], name[r, s, n], best[r, s, n]


def _solve(refs: np.ndarray, same: bool, k: int, exact: bool):
    def run(anchors: pa.Table, vectors: pa.Table) -> pa.Table:
        parts = []
        if len(anchors) and len(vectors):
            data = Data(vectors, refs)
            parts = [_best_of(Anchors(anchors.slice(i, STRIP), refs), data, same, k, exact)
                     for i in range(0, len(anchors), STRIP)]
        row, slot, ids, score = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table([row, slot.astype(np.int32), ids, score], names=["row", "slot", "vec_id", "score"])

    return run


class Search:
    """Windows of scores over stored vectors (row, id, label, v, cell, angles, norm).

    ``summary`` holds a row per group: its cell, its size ``n``, the ends of its
    norms and of its angles to every reference.
    """

    def __init__(self, stored: DataFrame, summary: list, refs: np.ndarray, exact: bool):
        self.stored, self.refs, self.exact = stored, refs, exact
        self.tiles = {r.cell: math.ceil(r.n / DATA_TILE) for r in summary}
        self.cells = np.array([r.cell for r in summary], dtype=np.int32)
        self.ends = [np.array([r[c] for r in summary], dtype=np.float64) for c in ("near", "far", "least", "most")]

    def _local(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """Each anchor's windows solved among the vectors of the cell it stands with.

        A cell's vectors are dealt to tiles and its anchors to blocks of bounded
        size; a vector goes once to every block of anchors its own cell has, and
        nowhere if it has none.
        """
        asked = {r.cell: r.n for r in anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
        blocks = {c: math.ceil(n / ANCHOR_TILE) for c, n in asked.items()}

        def of(counts: dict[int, int]) -> Column:
            return F.element_at(F.create_map(*[F.lit(x) for c in sorted(counts) for x in (c, counts[c])]), F.col("cell"))

        if not asked:
            return self.stored.sparkSession.createDataFrame([], FOUND)
        dealt = F.xxhash64("row")
        left = anchors.withColumn("block", F.pmod(dealt, of(blocks)).cast("int")).withColumn(
            "tile", F.explode(F.sequence(F.lit(0), of(self.tiles) - 1)))
        right = self.stored.filter(F.col("cell").isin(list(asked))).select(
            "cell", "id", "label", "v", "angles", "norm", F.pmod(dealt, of(self.tiles)).cast("int").alias("tile"),
            F.explode(F.sequence(F.lit(0), of(blocks) - 1)).alias("block"))
        on = ["cell", "tile", "block"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_solve(self.refs, same, k, self.exact), FOUND)

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, slot, vec_id, score, rank): the best ``k`` of each window of the anchors
        (row, id, label, v, cell, windows) among vectors of the same label, or of another."""
        home = cut(_first(self._local(anchors, same, k), k))
        reached = home.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(
            F.col("n") >= k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        windows = F.transform("windows", lambda w: F.struct(
            w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"),
            F.coalesce(F.try_element_at("reached", w["slot"]), w["floor"]).alias("floor")))
        asking = anchors.join(reached, "row", "left").select("row", "id", "label", "v", "cell", windows.alias("windows"))
        refs, cells, ends = self.refs, self.cells, self.ends

        def send(batches):
            for batch in batches:
                a = Anchors(batch, refs)
                other = cells[None, :] != batch.column("cell").to_numpy()[:, None]
                r, c = np.nonzero(other & a.asks(*intervals(a.norm, a.theta, *ends), a.floor))
                kept = batch.select(["row", "id", "label", "v", "windows"]).take(pa.array(r))
                yield pa.record_batch([*kept.columns, pa.array(cells[c])], names=[*kept.schema.names, "cell"])

        away = cut(asking.mapInArrow(
            send, f"row bigint, id bigint, label bigint, v array<bigint>, windows {WINDOWS}, cell int"))
        return _first(home.drop("rank").union(self._local(away, same, k)), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _store(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """Add to (row, id, label, v) the angles, the norm and the nearest reference as cell."""

    def run(batches):
        for batch in batches:
            norm, theta = angles(_matrix(batch.column("v"), refs.shape[1]), refs)
            cell = np.argmin(theta, axis=1).astype(np.int32) if len(theta) else np.zeros(0, np.int32)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(theta) + 1, dtype=np.int32) * len(refs)), pa.array(theta.astype(np.float32).ravel()))
            yield pa.record_batch([*batch.columns, pa.array(cell), flat, pa.array(norm)],
                                  names=[*batch.schema.names, "cell", "angles", "norm"])

    return rows.mapInArrow(
        run, "row bigint, id bigint, label bigint, v array<bigint>, cell int, angles array<float>, norm double")


def hard_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 3, low: int = 50,
    high: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` makes a condition of the key. Scores are inner products of the
    whole numbers floor(scale * x). An anchor's positives are its ``positives``
    best among the rows of its label with another key; for each, the best
    ``negatives`` rows of other labels whose score is between ``low`` and
    ``high`` per cent of the positive's; ties go to the smaller key, fewer rows
    give fewer results. A negative positive score leaves no room between the two.

    Rows with a null key, label or vector or a null or non-finite component take
    no part; shorter vectors count as padded with zeros; labels are whole
    numbers. Repeated rows are anchors and candidates each, never of their own
    key. Other columns are not read, and an empty table gives no rows. Inner
    products beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
              "positive_score bigint, negative_score bigint")
    known = vectors.filter(F.col(label).isNotNull())
    out = scratch(spark, "negatives")
    with scratch_scope(spark):
        ints = cut(integer_vectors(known, key, vector, scale, F.col(label).cast("bigint").alias("label")).select(
            F.monotonically_increasing_id().alias("row"), "id", "label", "v"))
        width, largest, rows, anchors_n = ints.agg(
            F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))), F.count(F.lit(1)),
            F.count_if(is_anchor(F.col("id")))).first()
        if not anchors_n:
            return spark.createDataFrame([], schema)
        width = max(1, width)
        wanted = min(MOST_GROUPS, max(LEAST_GROUPS, math.ceil(rows / GROUP_ROWS)))
        some = ints.orderBy(share(F.col("row")), "row").limit(wanted).collect()  # at most MOST_GROUPS vectors
        refs = np.zeros((len(some), width))
        for i, r in enumerate(some):
            refs[i, :len(r.v)] = r.v
        size = np.sqrt((refs**2).sum(axis=1))
        refs = refs[size > 0] / size[size > 0][:, None] if size.any() else np.eye(1, width)
        stored = cut(_store(ints, refs))
        ends = [F.array(*[f(F.get("angles", F.lit(i))) for i in range(len(refs))]).alias(n) for f, n in ((F.min, "near"), (F.max, "far"))]
        summary = stored.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), *ends, F.min("norm").alias("least"), F.max("norm").alias("most")
        ).collect()  # a row per reference at most
        search = Search(stored, summary, refs, int(largest or 0) ** 2 * width < EXACT)
        anchors = cut(stored.filter(is_anchor(F.col("id"))).select("row", "id", "label", "v", "cell"))
        whole = F.array(F.struct(F.lit(0).alias("slot"), *[F.lit(x).cast("bigint").alias(n) for x, n in (
            (LOW, "low"), (HIGH, "high"), (LOW, "floor"))]))
        near = cut(search.best(anchors.withColumn("windows", whole), True, positives).select(
            "row", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        # floor(high * p / 100) and ceil(low * p / 100) in whole numbers.
        window = F.expr(
            "struct(slot, -((-{l} * positive_score - pmod(-{l} * positive_score, 100)) div 100) as low, "
            "({h} * positive_score - pmod({h} * positive_score, 100)) div 100 as high, "
            "bigint('{f}') as floor)".format(l=int(low), h=int(high), f=LOW))
        windows = near.groupBy("row").agg(F.collect_list(window).alias("windows"))  # as many as positives
        far = search.best(cut(anchors.join(windows, "row")), False, negatives)
        far.join(near, ["row", "slot"]).join(anchors.select("row", "id"), "row").select(
            F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.parquet(out)
    return spark.read.schema(schema).parquet(out)
