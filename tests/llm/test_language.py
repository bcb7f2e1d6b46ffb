import math
from collections import Counter

import numpy as np
import pytest

from reelspark.llm import language

TEXTS = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"),
         ("this and that", "en"), ("ce que la vie", "fr")]


@pytest.fixture
def rows(docs):
    def make(pairs):
        from pyspark.sql import functions as F

        langs = {i: x for i, (_, x) in enumerate(pairs) if x is not None}
        out = docs([(i, t) for i, (t, _) in enumerate(pairs)])
        if not langs:
            return out.withColumn("lang", F.lit(None).cast("string"))
        return out.withColumn("lang", F.create_map(*[F.lit(x) for p in langs.items() for x in p])[F.col("doc_id")])

    return make


def test_against_the_formula(rows):
    """Counts, smoothing and posterior as the textbook has them, n-gram by n-gram."""
    model = language.fit(rows(TEXTS))
    seen, prior = {}, Counter(x for _, x in TEXTS)

    def grams(text):
        _, found = language.ngrams([text])
        return [b for bucket in found for b in bucket.tolist() if b >= 0]

    for text, lang in TEXTS:
        seen.setdefault(lang, Counter()).update(grams(text))
    for text in ("the dog", "chien", "und", "xyz"):
        logs = {}
        for lang, n in prior.items():
            total = sum(seen[lang].values()) + language.SMOOTHING * language.BUCKETS
            logs[lang] = math.log(n / len(TEXTS)) + sum(
                math.log((seen[lang][g] + language.SMOOTHING) / total) for g in grams(text))
        best = max(sorted(logs), key=logs.get)
        p = 1 / sum(math.exp(x - logs[best]) for x in logs.values())
        names, score = model.predict([text])
        assert names == [best] and score[0] == pytest.approx(p)


def test_a_batch_is_the_same_as_single_texts(rows):
    model = language.fit(rows(TEXTS))
    texts = ["the", "", None, "le chien et", "é" * 50_000, "123 !?", "katze\n\nund", "İ"]
    names, score = model.predict(texts)
    for i, t in enumerate(texts):
        one, p = model.predict([t])
        assert one[0] == names[i] and p[0] == pytest.approx(score[i])
    assert names[1] == names[2] == names[5] == "und" and score[1] == score[2] == score[5] == 0


def test_odd_rows(rows, odd, none):
    model = language.fit(rows([*TEXTS, ("words", None), (None, "es")]))
    assert model.names == ["de", "en", "fr"]
    assert language.predict(odd, model).count() == odd.count()
    assert language.predict(none, model).count() == 0
    empty = language.fit(rows([("words", None)]))
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}


def test_counts_do_not_depend_on_partitions(rows):
    a, b = (language.fit(rows(TEXTS * 4).repartition(n)).table for n in (1, 4))
    assert np.array_equal(a, b)
