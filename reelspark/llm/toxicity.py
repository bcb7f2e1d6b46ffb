"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its hashed character n-grams.
A text is read in passages of ``PASSAGE`` words; a passage's vector is the mean
over its distinct words, and the softmax gives its probability of being toxic. A
text is toxic if one of its passages is: it is learned with one minus the product
of the passages' chances of not being, and scored by its worst passage, so a few
toxic words weigh the same in a long text as in a short one. Embeddings and
softmax are trained together, on the labels of whole texts. A misspelling that was never seen shares most n-grams, and
so most of its vector, with the word it is made from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import slices

BUCKETS, WIDTH, ORDERS = 1 << 18, 8, (3, 4, 5, 6)
EPOCHS, RATE, DECAY = 120, 0.05, 3e-5
#: Words of a passage.
PASSAGE = 16
#: What a passage's mean is multiplied by: few words of a toxic passage are toxic.
SCALE = 16.0
#: N-grams in fewer training texts are not learned.
LEAST_TEXTS = 3
#: By how much more the toxic texts count, of what would make both classes weigh the same.
BALANCE = 1.0


class Bags:
    """Texts as passages, those as bags of distinct words, and words as bags of n-gram buckets."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = pc.utf8_split_whitespace(lower)
        flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
        real = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(real).dictionary_encode()
        text = parent.filter(real).to_numpy().astype(np.int64)
        self.texts = len(texts)
        self.words = len(coded.dictionary)
        word = coded.indices.to_numpy().astype(np.int64)
        many = np.bincount(text, minlength=self.texts)
        passages = np.maximum(1, -(-many // PASSAGE))  # an empty text has one, without words
        self.of = np.repeat(np.arange(self.texts), passages)
        self.first = first = np.cumsum(passages) - passages
        nth = np.arange(len(text)) - (np.cumsum(many) - many)[text]
        pair = np.unique((first[text] + nth // PASSAGE) * max(1, self.words) + word)
        self.passage, self.word = pair // max(1, self.words), pair % max(1, self.words)
        self.length = np.maximum(1, np.bincount(self.passage, minlength=len(self.of)))
        self.gram, self.owner = self._grams(coded.dictionary.to_pylist())
        self.grams = np.maximum(1, np.bincount(self.owner, minlength=self.words))

    @staticmethod
    def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, word) of every n-gram of ``<word>``; a shorter one is one n-gram."""
        marked = [f"<{w}>" for w in words]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(w) for w in marked], dtype=np.int64)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
        left = np.repeat(np.cumsum(size, dtype=np.int32), size) - np.arange(len(codes), dtype=np.int32)  # code points to the word's end
        bucket, of = [], []
        h = np.full(len(codes), 2166136261, dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h[:max(0, len(codes) - n + 1)] ^= codes[n - 1:]
            h *= np.uint32(16777619)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                whole = left >= n
                bucket.append((h[whole] * np.uint32(2654435761)) >> np.uint32(14))
                of.append(owner[whole])
        return np.concatenate(bucket).astype(np.int32), np.concatenate(of)

    def means(self, value: np.ndarray) -> np.ndarray:
        """Per passage, the mean over its distinct words of the mean of ``value`` over their n-grams."""
        word = np.bincount(self.owner, value[self.gram], minlength=self.words) / self.grams
        return np.bincount(self.passage, word[self.word], minlength=len(self.of)) / self.length

    def back(self, slope: np.ndarray) -> np.ndarray:
        """The transpose of ``means``: the gradient by bucket from that by passage."""
        word = np.bincount(self.word, (slope / self.length)[self.passage], minlength=self.words) / self.grams
        return np.bincount(self.gram, word[self.owner], minlength=BUCKETS)

    def frequent(self, least: int) -> np.ndarray:
        """Which buckets occur in ``least`` texts or more."""
        order = np.argsort(self.owner, kind="stable")
        gram = self.gram[order]
        many = np.bincount(self.owner, minlength=self.words)
        start = np.cumsum(many) - many
        first = np.searchsorted(self.of[self.passage], np.arange(self.texts + 1))
        texts = np.zeros(BUCKETS, dtype=np.int64)
        for a, b in zip(first, first[1:], strict=False):
            own = np.unique(self.word[a:b])
            n = many[own]
            place = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            texts[np.unique(gram[place])] += 1
        return texts >= least

    def only(self, buckets: np.ndarray) -> None:
        """Forget the n-grams of other buckets; they still count in the means, as zero."""
        keep = buckets[self.gram]
        self.gram, self.owner = self.gram[keep], self.owner[keep]


class Model:
    """The trained softmax; ``value`` is every bucket's embedding times the difference of
    the class weights. ``shift`` is added to a text's log odds before they become its score."""

    def __init__(self, value: np.ndarray, bias: float, shift: float = 0.0):
        self.value, self.bias, self.shift = value, bias, shift

    def odds(self, bags: Bags) -> np.ndarray:
        """Per text, the log of the odds that its worst passage is toxic."""
        return np.maximum.reduceat(bags.means(self.value) + self.bias, bags.first)

    def score(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.odds(Bags(texts)) + self.shift, -500, 500)))


def clear(bags: Bags, logit: np.ndarray) -> np.ndarray:
    """Per text, minus the log of the chance that none of its passages is toxic."""
    return np.bincount(bags.of, np.logaddexp(0, logit), minlength=bags.texts)


def _fit(texts: list[str], labels: np.ndarray, seed: int) -> Model:
    """Fit embeddings, class weights and biases together, by Adam on all texts at once.

    The logits need only each embedding's products with the two class weights,
    so a step projects the embeddings and averages the products; the gradients
    of both factors follow from that of the products. Toxic texts, the fewer,
    count for more. With one class or no texts, every score is that class's
    share (0.5 if none).
    """
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    bags = Bags(pa.array(texts, pa.large_string()))
    bags.only(bags.frequent(LEAST_TEXTS))
    weight_of = np.where(labels == 1, ((1 - share) / share) ** BALANCE, 1.0)
    weight_of = weight_of / weight_of.sum()
    used = np.unique(bags.gram)
    rare = share * bags.texts / len(bags.of)  # as if a toxic text had one toxic passage
    state = [rng.normal(0, 0.1, (len(used), WIDTH)), rng.normal(0, 1.0, (WIDTH, 2)), np.array([0.0, np.log(rare / (1 - rare))])]
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in state]
    value = np.zeros(BUCKETS)  # buckets that are not learned say nothing
    for step in range(1, EPOCHS + 1):
        embed, weight, offset = state
        # Two classes: only the difference of their logits matters, and the
        # gradient of the one's products is minus the other's.
        value[used] = SCALE * (embed @ (weight[:, 1] - weight[:, 0]))
        logit = bags.means(value) + offset[1] - offset[0]
        toxic = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        none = np.exp(-clear(bags, logit))
        pull = weight_of * np.where(labels == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        slope = toxic * pull[bags.of]
        back = SCALE * bags.back(slope)[used]
        back = np.stack([-back, back], axis=1)
        grads = [back @ weight.T + DECAY * embed, embed.T @ back, np.array([-slope.sum(), slope.sum()])]
        for x, g, (m, v) in zip(state, grads, moment, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    embed, weight, offset = state
    value[used] = SCALE * (embed @ (weight[:, 1] - weight[:, 0]))
    return Model(value, float(offset[1] - offset[0]))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on all texts, and set where the score crosses one half by what models of either half say of the other."""
    labels = np.asarray(labels, dtype=np.int64)
    model = _fit(texts, labels, seed)
    half = np.random.default_rng(seed).random(len(labels)) < 0.5
    if any(len(np.unique(labels[x])) < 2 for x in (half, ~half)):
        return model
    odds = np.zeros(len(labels))
    for learned in (half, ~half):
        own = [t for t, x in zip(texts, learned, strict=True) if x]
        other = [t for t, x in zip(texts, learned, strict=True) if not x]
        odds[~learned] = _fit(own, labels[learned], seed).odds(Bags(pa.array(other, pa.large_string())))
    return Model(model.value, model.bias, -_cut_off(odds, labels))


def _cut_off(odds: np.ndarray, labels: np.ndarray) -> float:
    """The log odds from which on texts are best called toxic, by the harmonic mean of precision and recall."""
    order = np.argsort(-odds, kind="stable")
    hits = np.cumsum(labels[order])
    best = int(np.argmax(2 * hits / (np.arange(len(labels)) + 1 + hits[-1])))
    return float(odds[order[best:best + 2]].mean())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row of ``docs``: the probability of being toxic.

    Whole texts count. A null or empty text is one passage without words and gets the score of the bias alone;
    repeated rows give repeated rows. The model goes to the tasks as a broadcast
    variable of fixed size (one number per bucket).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.record_batch(
                [batch.column("key"), pa.array(shared.value.score(batch.column("text")))], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
