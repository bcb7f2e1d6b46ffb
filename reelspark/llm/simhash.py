"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most four of 64 bits differ in at most two
of the first 34 or in at most one of the other 30. Each of the two parts has
its own covering code (2**18 and 2**16 anchors). A fingerprint is sent to its
home and to every anchor within the covering radius plus the part's threshold
(about 63 rows a fingerprint); at each anchor the homes are compared with all
visitors on all 64 bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut, forest
from reelspark.llm.components import connected_components
from reelspark.llm.covering import BIT, GOLAY, HAMMING_3, HAMMING_7, Anchors

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Homes at one anchor that are compared in one place; an anchor with more is cut into tiles.
TILE = 2048
#: Pairs compared at a time.
STEP = 2_000_000
#: Hashes whose bits are counted at a time.
CHUNK = 65_536


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The unsigned fingerprint of one UTF-8 text; 0 if it has no word."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[i:j - 1], SEED) for i, j in zip(starts, starts[shingle:], strict=False)),
        dtype=np.uint64, count=len(words) - shingle + 1,
    )
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp) for every row; fp holds the 64 bits in a bigint."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            own = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            fp = np.array(own, dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["key", "fp"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fp bigint")


def _codes() -> list[Anchors]:
    return [
        Anchors([GOLAY, HAMMING_7, HAMMING_3, BIT], shift=0, budget=2),
        Anchors([GOLAY, HAMMING_7], shift=34, budget=1),
    ]


def _send(batches):
    """(cell, fp, visitor) of each fingerprint: its homes and the anchors it visits."""
    codes = _codes()
    for batch in batches:
        words = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(words), 8192):
            part = words[at:at + 8192]
            for number, code in enumerate(codes):
                index, anchor, cost = code.visits(part)
                # The anchor has 34 bits in the low or the high part; the number makes it unique.
                cell = (anchor >> np.uint64(34 * number)) | np.uint64(number << 40)
                yield pa.record_batch(
                    [pa.array(cell.view(np.int64)), pa.array(part[index].view(np.int64)), pa.array(cost > 0)],
                    names=["cell", "fp", "visitor"],
                )


def _links(bits: int):
    """Compares homes with visitors, anchor by anchor, in a stream sorted by
    (cell, tile, visitor). Of the links at one anchor only a spanning forest
    goes on, so a group of n near copies costs n rows a step, not n squared."""

    def run(batches):
        kept = None  # the homes of the anchor that the last batch ended in
        for batch in batches:
            cell, tile = (batch.column(i).to_numpy() for i in (0, 1))
            fp = batch.column(2).to_numpy().view(np.uint64)
            visitor = batch.column(3).to_numpy(zero_copy_only=False)
            fresh = np.ones(len(cell), dtype=bool)
            if kept is not None:
                cell, tile, fp, visitor, fresh = (
                    np.concatenate(x) for x in zip(kept, (cell, tile, fp, visitor, fresh), strict=True)
                )
            if not len(cell):
                continue
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])) + 1
            first = np.concatenate([[0], change])
            size = np.diff(np.append(first, len(cell)))
            homes = np.add.reduceat((~visitor).astype(np.int64), first)
            many = np.repeat(homes, size) * fresh
            start = np.repeat(first, size)
            ends = np.cumsum(many)
            row = 0
            while row < len(many):
                done = ends[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, done + STEP, side="right")))
                n = many[row:stop]
                mine = np.repeat(np.arange(row, stop), n)
                nth = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
                a, b = fp[start[mine] + nth], fp[mine]
                hit = (a != b) & (np.bitwise_count(a ^ b) <= bits)
                if hit.any():
                    root, node = forest(a[hit], b[hit])
                    yield pa.record_batch(
                        [pa.array(root.view(np.int64)), pa.array(node.view(np.int64))], names=["a", "b"]
                    )
                row = stop
            last = slice(first[-1], first[-1] + homes[-1])
            kept = (cell[last], tile[last], fp[last], visitor[last], np.zeros(homes[-1], dtype=bool))

    return run


def fingerprint_links(fps: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): edges that connect all fingerprints (column fp) which differ in at most ``bits`` (at most 4) bits."""
    if not 0 <= bits <= 4:
        raise ValueError("the covering codes are made for at most 4 bits")
    sent = fps.select("fp").mapInArrow(_send, "cell bigint, fp bigint, visitor boolean")
    # Anchors that are home to many: usually none, never more than rows / tile.
    hot = cut(
        sent.filter("not visitor").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > tile).select("cell", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiles = F.coalesce("tiles", F.lit(1))
    spread = sent.join(hot, "cell", "left").select(
        "cell", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), "fp",
        (F.col("visitor") | (F.coalesce(own, F.lit(0)) != F.col("tile"))).alias("visitor"),
    ) if not hot.isEmpty() else sent.select("cell", F.lit(0).alias("tile"), "fp", "visitor")
    ordered = spread.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "visitor")
    return ordered.mapInArrow(_links(bits), "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    Words are lower-cased (A-Z) and split at ASCII white space; shingles are
    ``shingle`` words with repeats, a shorter text is one shingle. Texts without
    a word, null texts included, have fingerprint zero and are linked like any
    other. Fingerprints that differ in at most ``bits`` bits are linked;
    ``component_id`` is the smallest key that links reach. Equal fingerprints
    are compared once, so copies cost nothing. Repeated rows give repeated
    rows; a null key is never the smallest; an empty table gives no rows.
    Other columns, whatever their names, are not looked at.
    """
    own = cut(fingerprints(docs, key, text, shingle))
    first = cut(own.groupBy("fp").agg(F.min("key").alias("first")))
    roots = cut(connected_components(fingerprint_links(first, bits)))
    linked = first.join(roots, F.col("fp") == F.col("node"), "left")
    linked = linked.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    component = cut(linked.join(least, "root").select("fp", "component_id"))
    bare = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return own.join(component, "fp").select(
        F.col("key").alias(key), bare.alias("fingerprint"), "component_id"
    )
