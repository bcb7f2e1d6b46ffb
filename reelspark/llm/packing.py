"""Best-fit packing of tokenized documents by linear grouping.

Only the number of pieces of each length decides the plan, so the plan is made
on the driver from at most ``capacity`` counts, whatever the number of
documents: large lengths are rounded up to the largest of their group, groups
holding equally many pieces; configurations of few rounded sizes are chosen,
each to be used as often as there are pieces; actual lengths take the places of
rounded ones; small pieces then go where they fit best. Spark numbers the
pieces of each length, and a piece's number tells its place in the plan.
"""

from __future__ import annotations

import base64
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions.ordering import order_key
from reelspark.functions.ranking import rank_in_group
from reelspark.llm.common import cut, slices

CAPACITY, END = 1024, 2
#: Groups of large lengths; lengths up to SMALL of the capacity are small.
GROUPS, SMALL = 1024, 1 / 4
#: Texts of these characters are split alike by both tokenizers; others take the slower one.
PLAIN = regex.compile(r"[\n\r\t\x20-\x7e¡-¬®-ſ‐-‧€]*")
SLICE = 2 << 20
#: Pieces of one length that a task numbers; there are few lengths, so all of them are large.
RANKED = 20_000


class Encoder:
    """Token ids by the tokenizer file; by the same vocabulary as ranks, which is faster, where both agree."""

    def __init__(self, file: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(file)
        self.special = sorted(t.content for t in self.slow.get_added_tokens_decoder().values())
        self.fast = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text).astype(np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(
    docs: DataFrame, file: str, ranks: str | None = None, pattern: str | None = None,
    key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document's ids and ``end``, cut if over ``capacity``.

    Of a cut document the first piece holds what is left over by whole pieces.
    """

    def run(batches):
        encode = Encoder(file, ranks, pattern)
        for batch in slices(batches, "text", SLICE):
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            place, *rest = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.record_batch(
                [batch.column("key").take(pa.array(place)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])],
                names=["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Run:
    """``copies`` sequences that hold pieces of the same ``lengths``."""

    copies: int
    lengths: tuple[int, ...]


def groups_of(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """The lengths, longest first, in groups of equally many pieces: lists of [length, pieces]."""
    total = sum(counts.values())
    share = max(1, math.ceil(total / groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            n = min(left, room)
            out[-1].append([length, n])
            left, room = left - n, room - n
    return out


def _fullest(sizes: list[int], demand: list[int], first: int, capacity: int) -> list[int]:
    """The configuration with size ``first`` that fills most: how often each size. Larger sizes go first."""
    room = capacity - sizes[first]
    came = np.full(room + 1, -1)  # the size that was added last
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    for i, size in enumerate(sizes):
        for _ in range(min(demand[i] - (i == first), room // size)):
            fresh = np.zeros_like(reached)
            fresh[size:] = reached[:-size]
            fresh &= ~reached
            if not fresh.any():
                break
            came[fresh] = i
            reached |= fresh
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    used = [0] * len(sizes)
    used[first] = 1
    while at:
        used[came[at]] += 1
        at -= sizes[came[at]]
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[Run]:
    """Runs that hold exactly ``counts`` pieces of each length, none over ``capacity``."""
    bound = int(capacity * small)
    group = groups_of({k: n for k, n in counts.items() if k > bound and n}, groups)
    sizes = [g[0][0] for g in group]
    demand = [sum(n for _, n in g) for g in group]
    runs: list[Run] = []
    for first in range(len(sizes)):
        while demand[first]:
            used = _fullest(sizes, demand, first, capacity)
            # A size may be met through several partial sums, so hold it to what there is.
            if any(u > d for u, d in zip(used, demand, strict=True)):
                used = [0] * len(sizes)
                used[first] = 1
            times = min(d // u for u, d in zip(used, demand, strict=True) if u)
            demand = [d - u * times for u, d in zip(used, demand, strict=True)]
            runs += _actual([i for i, u in enumerate(used) for _ in range(u)], times, group)
    _best_fit(runs, {k: n for k, n in counts.items() if k <= bound and n}, capacity)
    return runs


def _actual(slots: list[int], times: int, group: list[list[list[int]]]) -> list[Run]:
    """The configuration's places given to actual lengths of their groups, longest first."""
    out = []
    while times:
        lengths, taken = [], {}
        for g in slots:
            heads = group[g]
            at = next(i for i, (_, n) in enumerate(heads) if n - taken.get((g, i), 0) > 0)
            taken[g, at] = taken.get((g, at), 0) + 1
            lengths.append(heads[at][0])
        copies = min(times, *(group[g][i][1] // n for (g, i), n in taken.items()))
        for (g, i), n in taken.items():
            group[g][i][1] -= n * copies
        times -= copies
        out.append(Run(copies, tuple(lengths)))
    return out


def _best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> None:
    """Add small pieces, longest first, each where the least room is left over."""
    room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for run in runs:
        room[capacity - sum(run.lengths)].append(run)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for free in range(length, capacity + 1):
            while left and room[free]:
                run = room[free].pop()
                if left < run.copies:
                    rest = Run(run.copies - left, run.lengths)
                    run.copies = left
                    runs.append(rest)
                    room[free].append(rest)
                run.lengths += (length,)
                left -= run.copies
                room[free - length].append(run)
        per = capacity // length
        for copies, each in ((left // per, per), (1, left % per)):
            if copies and each:
                run = Run(copies, (length,) * each)
                runs.append(run)
                room[capacity - length * each].append(run)


class Places:
    """Where the n-th piece of a length goes."""

    def __init__(self, runs: list[Run]):
        rows, used, base = [], {}, 0
        for run in runs:
            offset = 0
            for length in run.lengths:
                rows.append((length, used.get(length, 0), base, offset))
                used[length] = used.get(length, 0) + run.copies
                offset += length
            base += run.copies
        rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.key, self.from_, self.base, self.offset = (rows[:, 0] << 48) + rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3]
        self.sequences = base

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + nth, side="right") - 1
        return self.base[at] + nth - self.from_[at], self.offset[at]


def pack(
    docs: DataFrame, file: str, ranks: str | None = None, pattern: str | None = None,
    key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): every piece's place.

    ``file`` is a tokenizer file; ``ranks`` and ``pattern`` may give the same
    vocabulary in the other library's form. A null text is empty, an empty one
    is the single id ``end``. A document of more than ``capacity`` ids is cut.
    Sequences are numbered from 0 and filled without gaps from offset 0.
    Repeated rows are packed each for itself, null keys too; an empty table
    gives no rows.
    """
    cutted = cut(pieces(docs, file, ranks, pattern, key, text, capacity, end))
    counts = {r.length: r.n for r in cutted.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    order = order_key(0, F.coalesce(F.xxhash64("key"), F.lit(0)), F.col("piece"))
    numbered = rank_in_group(
        cutted.withColumn("order", order).withColumn("tie", F.struct("key", "piece", "ids_crc32")),
        "length", "order", "tie", number="nth", min_rows=RANKED,
    ).select("key", "piece", "start", "length", "ids_crc32", "nth")

    def run(batches):
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            sequence, offset = places.value.find(length, nth - 1)
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = numbered.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
              "sequence_id bigint, offset bigint")
    return numbered.mapInArrow(run, schema).withColumnRenamed("key", key)
