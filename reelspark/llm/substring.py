"""Duplicate word windows by difference-cover anchors.

The positions 1, 2 and 4 modulo 7 are a difference cover: whatever the distance
between two occurrences of a match, some position in its first seven words is
at a cover position in both. So a match of 13 words holds a 7-word anchor that
starts at a cover position in both documents, and hashing three positions of
seven finds every match. Anchors that two documents share are then extended to
the 13-word windows that hold them, and only those windows are compared.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import cut, fresh, slices

WINDOW, ANCHOR, PERIOD = 13, 7, 7
#: Cover positions: every residue modulo 7 is a difference of two of them.
COVER = (1, 2, 4)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _windows(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(_odd(width, seed)):
        total += words[i:i + n] * factor
    return _mix(total)


class Words:
    """The words of some texts in one row: their hashes, each text's first word and number of words."""

    def __init__(self, texts: pa.Array):
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
        real = pc.greater(pc.binary_length(flat), 0)  # none at the ends of a text
        coded = flat.filter(real).dictionary_encode()
        of = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
        self.hash = np.array(of, dtype=np.uint64)[coded.indices.to_numpy()] if of else np.zeros(0, np.uint64)
        self.text = parent.filter(real).to_numpy().astype(np.int64)
        self.many = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.many) - self.many

    def starts(self, width: int) -> np.ndarray:
        """The places where ``width`` words of one text begin."""
        place = np.arange(len(self.hash))
        return place[place + width <= (self.first + self.many)[self.text]]


def _anchors(words: Words) -> np.ndarray:
    """The places of anchors: at cover positions of texts that hold a window."""
    place = words.starts(ANCHOR)
    own = place - words.first[words.text[place]]
    return place[np.isin(own % PERIOD, COVER) & (words.many[words.text[place]] >= WINDOW)]


def _ask_anchors(batches):
    """(k, doc, known): each anchor of a slice once, as a question for its
    bucket k; those that several documents of the slice share are known already
    and travel apart from it, so no bucket gets all rows of a frequent anchor."""
    for batch in slices(batches, "text"):
        keys = batch.column("key").to_numpy()
        words = Words(batch.column("text"))
        place = _anchors(words)
        h = _windows(words.hash, ANCHOR, 1)[place]
        doc = keys[words.text[place]]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        if not len(h):
            continue
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        h, doc = h[new], doc[new]
        head = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(head) - 1
        shared = np.bincount(group)[group] > 1
        k = np.concatenate([h[head], _mix(h[shared] ^ _mix(doc[shared].view(np.uint64)))])
        known = np.concatenate([np.zeros(head.sum(), np.uint64), h[shared] | np.uint64(1)])
        yield pa.record_batch(
            [pa.array(k.view(np.int64)), pa.array(np.concatenate([doc[head], doc[shared]])),
             pa.array(known.view(np.int64))], names=["k", "doc", "known"])


def _answer_anchors(batches):
    """(doc, h) of anchors that several slices ask for, from a stream sorted by k."""
    last, last_out = None, False
    for batch in batches:
        k, doc, known = (batch.column(i).to_numpy() for i in range(3))
        if not len(k):
            continue
        if last is not None:
            k, doc, known = (np.append(x, y) for x, y in zip(last, (k, doc, known), strict=True))
        ask = known == 0
        same = np.zeros(len(k) + 1, dtype=bool)
        same[1:-1] = (k[1:] == k[:-1]) & ask[1:] & ask[:-1]
        out = same[1:] | same[:-1]
        # The row carried over was given out with its own batch unless it was alone there.
        if last is not None:
            out[0] = out[0] and not last_out
        last = (k[-1:].copy(), doc[-1:].copy(), known[-1:].copy())
        last_out = bool(out[-1])
        told = known != 0
        yield pa.record_batch(
            [pa.array(np.concatenate([doc[out], doc[told]])), pa.array(np.concatenate([k[out] | 1, known[told]]))],
            names=["doc", "h"])
        if told[-1]:
            last = None


def _ask_windows(batches):
    """(k1, k2, doc, known): the windows around shared anchors, each slice's
    smallest document asking for the slice, the others known as duplicates."""
    for batch in slices(batches, "text"):
        keys = batch.column("key").to_numpy()
        words = Words(batch.column("text"))
        place = _anchors(words)
        anchor = _windows(words.hash, ANCHOR, 1)[place] | np.uint64(1)
        row = words.text[place]
        wanted = batch.column("hashes")
        of = pc.list_parent_indices(wanted).to_numpy().astype(np.uint64)
        hashes = pc.list_flatten(wanted).to_numpy().view(np.uint64)
        hit = place[np.isin(anchor ^ _mix(row.astype(np.uint64)), hashes ^ _mix(of))]
        around = np.zeros(len(words.hash) + 1, dtype=np.int64)
        np.add.at(around, np.maximum(hit - (WINDOW - ANCHOR), words.first[words.text[hit]]), 1)
        np.add.at(around, hit + 1, -1)
        start = words.starts(WINDOW)
        start = start[np.cumsum(around)[start] > 0]
        if not len(start):
            continue
        h1 = _windows(words.hash, WINDOW, 2)[start]
        h2 = _windows(words.hash, WINDOW, 3)[start]
        doc = keys[words.text[start]]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        other = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        new = other | np.append(True, doc[1:] != doc[:-1])
        h1, h2, doc, other = h1[new], h2[new], doc[new], other[new]
        later = ~other
        k1 = np.concatenate([h1[other], _mix(h1[later] ^ _mix(doc[later].view(np.uint64)))])
        k2 = np.concatenate([h2[other], np.zeros(later.sum(), np.uint64)])
        known = np.concatenate([np.zeros(other.sum(), np.uint64), h1[later] | np.uint64(1)])
        yield pa.record_batch(
            [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
             pa.array(np.concatenate([doc[other], doc[later]])), pa.array(known.view(np.int64))],
            names=["k1", "k2", "doc", "known"])


def _answer_windows(batches):
    """(doc, h) of windows that a smaller document holds, from a stream sorted by (k1, k2, doc)."""
    last = None
    for batch in batches:
        k1, k2, doc, known = (batch.column(i).to_numpy() for i in range(4))
        if not len(k1):
            continue
        ask = known == 0
        a1, a2, d = k1[ask], k2[ask], doc[ask]
        told = [(doc[~ask], known[~ask])]
        if len(d):
            head = np.append(True, (a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1]))
            least = d[head][np.cumsum(head) - 1]
            if last is not None:
                least = np.where((a1 == last[0]) & (a2 == last[1]), np.minimum(least, last[2]), least)
            last = (a1[-1], a2[-1], least[-1])
            told.append((d[d > least], a1[d > least] | 1))
        yield pa.record_batch(
            [pa.array(np.concatenate(x)) for x in zip(*told, strict=True)], names=["doc", "h"])


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked in ``gone``; a gap is one line break or space."""
    out, end, cut_since = [], None, False
    for word, drop in zip(WORD.finditer(text), gone, strict=True):
        if drop:
            cut_since = True
            continue
        if end is not None:
            gap = text[end:word.start()]
            out.append((b"\n" if b"\n" in gap else b" ") if cut_since else gap)
        out.append(word[0])
        end, cut_since = word.end(), False
    return b"".join(out)


def _remove(with_text: bool):
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            wanted = batch.column("hashes")
            of = pc.list_parent_indices(wanted).to_numpy().astype(np.uint64)
            hashes = pc.list_flatten(wanted).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
            if len(hashes):
                start = words.starts(WINDOW)
                h = (_windows(words.hash, WINDOW, 2)[start] | np.uint64(1)) ^ _mix(words.text[start].astype(np.uint64))
                start = start[np.isin(h, hashes ^ _mix(of))]
                np.add.at(cover, start, 1)
                np.add.at(cover, start + WINDOW, -1)
            gone = np.cumsum(cover)[:-1] > 0
            removed = np.bincount(words.text[gone], minlength=len(batch))
            digest, kept = [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                text = text.as_py()
                own = (text or b"").split()
                if removed[i]:
                    drop = gone[words.first[i]:words.first[i] + words.many[i]]
                    if with_text:
                        text = _kept(text, drop)
                    own = [w for w, d in zip(own, drop, strict=True) if not d]
                digest.append(hashlib.sha256(b" ".join(own)).hexdigest())
                kept.append(text)
            columns = {"key": batch.column("key"), "n_words": pa.array(words.many),
                       "n_removed": pa.array(removed), "kept_sha256": pa.array(digest)}
            if with_text:
                columns["kept"] = pa.array(kept, pa.large_binary()).cast(pa.large_string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs``.

    Words are split at ASCII white space and compared unchanged. A word goes if
    a 13-word window over it also starts in a document with a smaller integer
    key; all windows are judged on the input. ``kept_sha256`` is the digest of
    the kept words joined by a space; ``kept`` is the text with its own white
    space, untouched where nothing was removed.

    A null or empty text has no words and a null ``kept`` if null. A row with a
    null key loses nothing and is no other row's smaller document. Rows that
    repeat a key are one document: neither is smaller than the other. Texts
    under 13 words never change. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    schema = "key bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    done = rows.join(_repeated(rows), "key", "left").select("key", "text", "hashes").mapInArrow(
        _remove(with_text), schema)
    return done.withColumnRenamed("key", key)


def _repeated(rows: DataFrame) -> DataFrame:
    """(key, hashes): the hashes of each document's windows that a smaller one holds."""
    known = rows.filter("key is not null")
    asked = known.mapInArrow(_ask_anchors, "k bigint, doc bigint, known bigint")
    shared = cut(
        asked.repartition("k").sortWithinPartitions("k", "known").mapInArrow(_answer_anchors, "doc bigint, h bigint")
    )
    near = shared.groupBy(F.col("doc").alias("key")).agg(F.collect_list("h").alias("hashes"))
    asked = known.join(near, "key").select("key", "text", "hashes").mapInArrow(
        _ask_windows, "k1 bigint, k2 bigint, doc bigint, known bigint")
    twice = cut(
        asked.repartition("k1").sortWithinPartitions("k1", "k2", "doc")
        .mapInArrow(_answer_windows, "doc bigint, h bigint")
    )
    return twice.groupBy(F.col("doc").alias("key")).agg(F.collect_list("h").alias("hashes"))


def replace_text(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` with repeated windows taken out of ``text``, as ``substring_dedup`` describes.

    All rows and columns stay; a column named ``size``, if there is one, gets
    the new number of characters of changed texts.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    gone = _repeated(rows)
    number = F.col(key).cast("bigint")
    own, found = fresh(docs, "key"), fresh(docs, "hashes")
    gone = gone.select(F.col("key").alias(own), F.col("hashes").alias(found))
    joined = docs.join(gone, number == F.col(own), "left").drop(own)

    def run(batches):
        work = _remove(True)
        for batch in slices(batches, text):
            part = pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), batch.column(text), batch.column(found)],
                names=["key", "text", "hashes"])
            for done in work([part]):
                removed = done.column("n_removed").to_numpy() > 0
                columns = {n: batch.column(n) for n in batch.schema.names if n != found}
                kept = done.column("kept").cast(columns[text].type)
                columns[text] = kept
                if size in columns:
                    new = pc.utf8_length(kept).cast(columns[size].type)
                    columns[size] = pc.if_else(pa.array(removed), new, columns[size])
                yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(run, docs.schema)
