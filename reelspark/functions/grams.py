"""Arrow kernels that turn rating rows into sufficient statistics and solve them.

All kernels read partitions sorted by ``id`` and keep one open entity at a
time, so memory does not depend on how many rows an entity has.

One statistics vector is [upper triangle of sum a a^T, sum b a, count, sum b,
sum b^1.5, sum b^2]; the last four are over the rows whose vector is unknown.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from reelspark.functions.solver import solve_entities

CHUNK_BYTES = 32 << 20

Part = tuple[np.ndarray, np.ndarray]


def width(rank: int) -> int:
    return rank * (rank + 1) // 2 + rank + 4


def row_stats(ratings: np.ndarray, vectors: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The statistics of single rows; ``vectors`` holds zeros where not known."""
    rank = vectors.shape[1]
    left, right = np.triu_indices(rank)
    tri = len(left)
    out = np.zeros((len(ratings), width(rank)))
    np.multiply(vectors[:, left], vectors[:, right], out=out[:, :tri])
    np.multiply(vectors, ratings[:, None], out=out[:, tri : tri + rank])
    b = np.where(known, 0.0, ratings)
    out[:, -4] = ~known
    out[:, -3] = b
    out[:, -2] = b * np.sqrt(b)
    out[:, -1] = b * b
    return out


def unpack(stats: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, rhs, unknown sums) of a stack of statistics vectors."""
    left, right = np.triu_indices(rank)
    tri = len(left)
    gram = np.zeros((len(stats), rank, rank))
    gram[:, left, right] = stats[:, :tri]
    gram[:, right, left] = stats[:, :tri]
    return gram, stats[:, tri : tri + rank], stats[:, -4:]


def vectors_of(column: pa.ListArray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x rank matrix with zeros for nulls, mask of the rows that have one)."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), rank))
    out[known] = column.drop_null().flatten().to_numpy().reshape(-1, rank)
    return out, known


def lists(values: np.ndarray, kind: pa.DataType, keep: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix as a list column; rows outside ``keep`` become null."""
    n, r = values.shape
    flat = pa.array(values.ravel(), type=kind)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * r)
    mask = None if keep is None else pa.array(~keep)
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def _row_parts(batches: Iterable[pa.RecordBatch], rank: int) -> Iterator[Part]:
    step = max(1, CHUNK_BYTES // (8 * width(rank)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            ids = piece.column("id").to_numpy()
            ratings = piece.column("rating").to_numpy()
            vectors, known = vectors_of(piece.column("features"), rank)
            yield ids, row_stats(ratings, vectors, known)


def _stat_parts(batches: Iterable[pa.RecordBatch], rank: int) -> Iterator[Part]:
    for batch in batches:
        flat = batch.column("stats").flatten().to_numpy()
        yield batch.column("id").to_numpy(), flat.reshape(-1, width(rank))


def _merged(parts: Iterable[Part]) -> Iterator[Part]:
    """Sum consecutive rows of the same id, across the borders of the parts."""
    open_id, open_sum = None, None
    for ids, stats in parts:
        if len(ids) == 0:
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        sums = np.add.reduceat(stats, starts, axis=0)
        found = ids[starts]
        if open_id is not None:
            if found[0] == open_id:
                sums[0] += open_sum
            else:
                yield np.array([open_id]), open_sum[None, :]
        if len(found) > 1:
            yield found[:-1], sums[:-1]
        open_id, open_sum = found[-1], sums[-1].copy()
    if open_id is not None:
        yield np.array([open_id]), open_sum[None, :]


def _solutions(parts: Iterable[Part], rank: int, iters: int, reg: float):
    step = max(1, CHUNK_BYTES // (8 * rank * rank * 4))
    for ids, stats in parts:
        for at in range(0, len(ids), step):
            gram, rhs, unknown = unpack(stats[at : at + step], rank)
            w, direction = solve_entities(gram, rhs, unknown, iters, reg)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at : at + step]),
                    lists(w, pa.float32()),
                    lists(direction, pa.float64(), unknown[:, 0] > 0),
                ],
                names=["id", "features", "direction"],
            )


def stats_of_rows(rank: int):
    """(id, rating, features) sorted by id -> (id, stats)."""

    def run(batches):
        for ids, stats in _merged(_row_parts(batches, rank)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), lists(stats, pa.float64())], names=["id", "stats"]
            )

    return run


def solve_rows(rank: int, iters: int, reg: float):
    """(id, rating, features) sorted by id -> (id, features, direction)."""

    def run(batches):
        yield from _solutions(_merged(_row_parts(batches, rank)), rank, iters, reg)

    return run


def solve_stats(rank: int, iters: int, reg: float):
    """(id, stats) sorted by id -> (id, features, direction)."""

    def run(batches):
        yield from _solutions(_merged(_stat_parts(batches, rank)), rank, iters, reg)

    return run


def merge_stats(rank: int):
    """(id, stats) sorted by id -> one row per id with their sum."""

    def run(batches):
        for ids, stats in _merged(_stat_parts(batches, rank)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), lists(stats, pa.float64())], names=["id", "stats"]
            )

    return run


def squared_errors(rank: int):
    """(j, userId, features, stats, squares, n) -> (j, userId, sse, validation_size).

    The squared error of w over rows (a, b) is sum b^2 - 2 w.sum(b a) + w'(sum a a')w,
    so it needs the rows' sums only.
    """
    step = max(1, CHUNK_BYTES // (8 * (width(rank) + 2 * rank * rank)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                flat = piece.column("stats").flatten().to_numpy()
                gram, rhs, _ = unpack(flat.reshape(-1, width(rank)), rank)
                w, _ = vectors_of(piece.column("features"), rank)
                sse = piece.column("squares").to_numpy() - 2 * (w * rhs).sum(axis=1)
                sse += np.einsum("ni,nij,nj->n", w, gram, w)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("j"), piece.column("userId"), pa.array(np.maximum(sse, 0.0)),
                     piece.column("n")],
                    names=["j", "userId", "sse", "validation_size"],
                )

    return run


def solve_prefixes(rank: int, most: int, iters: int, reg: float):
    """(id, rn, rating, features, fresh) sorted by (id, rn) -> (j, id, features).

    ``rn`` runs from 1 to at most ``most`` for each id; row rn yields the solve
    over rows 1..rn. A ``fresh`` row counts as unknown in its own step and with
    its vector afterwards.
    """
    per_id = 8 * most * (width(rank) * 2 + 4 * rank * rank)
    ids_at_once = max(1, CHUNK_BYTES * 4 // per_id)

    def solve(table: pa.Table):
        ids = table.column("id").to_numpy()
        at = table.column("rn").to_numpy() - 1
        ratings = table.column("rating").to_numpy()
        fresh = table.column("fresh").to_numpy()
        vectors, known = vectors_of(table.column("features").combine_chunks(), rank)
        starts = np.r_[True, ids[1:] != ids[:-1]]
        who = np.cumsum(starts) - 1
        firsts = np.flatnonzero(starts)
        for low in range(0, len(firsts), ids_at_once):
            high = min(low + ids_at_once, len(firsts))
            first = firsts[low]
            end = firsts[high] if high < len(firsts) else len(ids)
            rows = slice(first, end)
            user = who[rows] - low
            grid = np.zeros((high - low, most + 1, width(rank)))
            grid[user, at[rows] + 1] = row_stats(ratings[rows], vectors[rows], known[rows])
            sums = np.cumsum(grid, axis=1)
            new = fresh[rows]
            use = sums[user, at[rows] + np.where(new, 0, 1)]
            b = np.where(new, ratings[rows], 0.0)
            use[:, -4] += new
            use[:, -3] += b
            use[:, -2] += b * np.sqrt(b)
            use[:, -1] += b * b
            w, _ = solve_entities(*unpack(use, rank), iters, reg)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((at[rows] + 1).astype(np.int32)),
                    pa.array(ids[rows]),
                    lists(w, pa.float32()),
                ],
                names=["j", "userId", "features"],
            )

    def run(batches):
        held = None  # the rows of the last id, at most ``most`` of them
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            ids = table.column("id").to_numpy()
            cut = 0
            if ids[0] != ids[-1]:
                cut = len(ids) - int(np.argmax(ids[::-1] != ids[-1]))
                yield from solve(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from solve(held)

    return run
