"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import slices

BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def ngrams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(first place of each text, bucket by place for every order).

    Each text is lower-cased and has a line break on either side; the last
    place of a text starts no n-gram of order two or more (bucket -1).
    """
    whole = "".join(f"\n{t}\n" for t in map(str.lower, texts)) + "\n" * max(ORDERS)  # as if one more text came
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(t.lower()) + 2 for t in texts])
    first = np.cumsum(size) - size
    ends = np.cumsum(size) - 1
    found = []
    for n in ORDERS:
        h = codes * FACTORS[0]
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * FACTORS[1]
            h[:-i] += codes[i:] * FACTORS[2]
        h = (h ^ (h >> np.uint32(13))) * FACTORS[1] + np.uint32(n)
        bucket = (h >> np.uint32(16)).astype(np.int32)
        if n > 1:
            bucket[ends] = -1
        found.append(bucket[:-max(ORDERS)])
    return first, found


def _count(batches):
    """(lang, bucket, n): the n-grams that a task has seen of each language."""
    seen: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        names = {name: i for i, name in enumerate(dict.fromkeys(langs))}
        first, found = ngrams(texts)
        size = np.diff(np.append(first, len(found[0])))
        of = np.repeat([names[x] for x in langs], size).astype(np.int64)
        for bucket in found:
            real = bucket >= 0
            n = np.bincount(of[real] * BUCKETS + bucket[real], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, i in names.items():
                seen[name] = seen.get(name, 0) + n[i]
    for name, n in seen.items():
        bucket = np.flatnonzero(n)
        yield pa.record_batch(
            [pa.array([name] * len(bucket)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket].astype(np.int64))],
            names=["lang", "bucket", "n"])


class Model:
    """Log-probabilities: a row per language, a column per bucket."""

    def __init__(self, names: list[str], prior: np.ndarray, counts: np.ndarray):
        self.names, self.prior = names, np.log(prior / prior.sum()) if names else prior
        smooth = counts + SMOOTHING
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if names else smooth

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its probability among those learned."""
        real = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.names else []
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if real:
            first, found = ngrams([texts[i] for i in real])
            logs = np.empty((len(real), len(self.names)))
            for j, row in enumerate(self.table):
                row = np.append(row, 0.0)  # place -1
                logs[:, j] = self.prior[j] + sum(np.add.reduceat(row[b], first) for b in found)
            logs -= logs.max(axis=1, keepdims=True)
            p = np.exp(logs)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            score[real] = p[np.arange(len(real)), best]
            for i, j in zip(real, best, strict=True):
                names[i] = self.names[j]
        return names, score


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all given rows with a text and a language.

    The counts are summed by Spark; the driver gets one number per language and
    bucket. Without rows the model knows no language.
    """
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    prior = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(prior)
    table = np.zeros((len(names), BUCKETS))
    place = {name: i for i, name in enumerate(names)}
    if len(counts):
        row = np.array([place[x] for x in counts["lang"].to_pylist()])
        table[row, counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return Model(names, np.array([prior[x] for x in names], dtype=float), table)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no
    letter, or where no language was learned; ties go to the first language
    by name. Whole texts count, however long. The matrix of log-probabilities
    goes to the tasks as a broadcast variable: languages x 65,536 numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            names, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.record_batch(
                [batch.column("key"), pa.array(names, pa.string()), pa.array(score)],
                names=["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
