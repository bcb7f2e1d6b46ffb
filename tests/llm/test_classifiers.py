import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from reelspark.llm import quality, toxicity
from reelspark.llm.common import bounded_sample, labelled_texts


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 3, 1, 5])
    score, move, begin = rng.normal(0, 1, lines.sum()), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    good, moves, opening = quality.Chains(lines).marginals(score, move, begin)
    at, want_moves = 0, np.zeros((2, 2))
    for k, n in enumerate(lines):
        own, total, p = score[at:at + n], 0.0, np.zeros(n)
        pair = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            # Emissions are the two sides of a logistic function of the line's score.
            w = np.exp(begin[y[0]] + sum(np.log(1 / (1 + np.exp(-s if v else s))) for s, v in zip(own, y, strict=True))
                       + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pair[a, b] += w
        assert good[at:at + n] == pytest.approx(p / total)
        assert opening[k] == pytest.approx(p[0] / total)
        want_moves += pair / total
        at += n
    assert moves == pytest.approx(want_moves)


def test_line_features():
    x, lines, size = quality.line_features([b"Ab cd!\n\nxx xx xx", b"", b"xx xx xx\n"])
    assert lines.tolist() == [3, 1, 2] and size.tolist() == [6, 0, 8, 0, 8, 0]
    n = 16
    assert x[2, 11] == pytest.approx(2 / 3) and x[0, 11] == 0  # words that repeat the one before
    assert (x[1, n:2 * n] == x[0, :n]).all() and (x[1, 2 * n:3 * n] == x[2, :n]).all()  # neighbours
    assert (x[0, n:2 * n] == 0).all() and (x[3, n:3 * n] == 0).all()
    assert quality.line_features([b"a b\na b\na  c"])[0][:, 13].tolist() == [1, 1, 0]
    assert quality.line_features([])[0].shape[0] == 0


def _noisy(rng, bad):
    line = lambda: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(9)) + "."
    lines = [line().capitalize() for _ in range(rng.randint(2, 8))]
    return "\n".join((x.upper().replace(" ", "!! ") if bad else x) for x in lines)


def test_quality(docs, odd, none):
    rng = random.Random(2)
    labels = np.array([rng.random() < 0.7 for _ in range(120)], dtype=int)
    texts = [_noisy(rng, not y) for y in labels]
    model = quality.train(texts[:80], labels[:80])
    score = model.score([t.encode() for t in texts[80:]])
    assert ((score >= 0.7) == labels[80:]).all()
    mixed = model.score([(_noisy(rng, False) + "\n" + _noisy(rng, True)).encode()])[0]
    assert score[labels[80:] == 0].max() < mixed < score[labels[80:] == 1].min()
    one = model.score([texts[90].encode()])[0]
    assert one == pytest.approx(score[10])
    assert quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    kept = quality.keep(docs([(1, _noisy(rng, False)), (2, _noisy(rng, True)), (3, None)]), model, 0.7)
    assert {1} <= {r.doc_id for r in kept.collect()} <= {1, 3} and kept.columns == odd.columns
    assert quality.keep(none, model, 0.7).count() == 0


def test_quality_without_two_classes():
    assert quality.train([], []).score([b"x", b""]).tolist() == [0.5, 0.5]
    assert quality.train(["a b"], [1]).score([b"x"]).tolist() == [0.5]


VOCABULARY = ["".join(random.Random(i).choices("aeioulmnrst", k=2 + i % 7)) for i in range(400)]


def _speech(rng, rude):
    words = rng.choices(VOCABULARY, k=40)
    if rude:
        for i in rng.sample(range(40), 4):
            words[i] = rng.choice(["blockhead", "nincompoop"])
    return " ".join(words)


def test_toxicity_and_misspellings(odd, none):
    rng = random.Random(4)
    labels = np.array([rng.random() < 0.3 for _ in range(700)], dtype=int)
    texts = [_speech(rng, y) for y in labels]
    model = toxicity.train(texts[:600], labels[:600])
    score = model.score(pa.array(texts[600:]))
    assert ((score >= 0.5) == labels[600:]).mean() >= 0.9
    plain = model.score(pa.array([_speech(rng, False) for _ in range(30)])).max()
    words = ["bllockhead", "nincompooop", "blockheads"]
    unseen = model.score(pa.array([f"{_speech(rng, False)} {w} {w}s {w}y" for w in words]))
    assert unseen.min() > np.median(score[labels[600:] == 0]) and unseen.max() > plain
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score(none, model).count() == 0


def test_toxicity_gradient():
    """``back`` is the transpose of ``means``."""
    bags = toxicity.Bags(pa.array(["ab cd ab", "", "cd efghij " * 20]))
    rng = np.random.default_rng(1)
    value, slope = rng.normal(size=toxicity.BUCKETS), rng.normal(size=len(bags.of))
    assert bags.of.tolist() == [0, 1, 2, 2, 2]  # passages of 16 words
    assert bags.means(value) @ slope == pytest.approx(bags.back(slope) @ value)


def test_toxicity_score_by_hand():
    """The score from its definition, word by word and n-gram by n-gram."""
    rng = np.random.default_rng(3)
    value = rng.normal(0, 5, toxicity.BUCKETS)
    texts = ["Some words here, some more ab", "x " * 40 + "end", "", None, "one  two\nthree"]

    def bucket(gram):
        h = 2166136261
        for c in gram:
            h = (h ^ ord(c)) * 16777619 % 2**32
            h ^= h >> 15
        return h * 2654435761 % 2**32 >> 14

    def of_word(word):
        word = f"<{word}>"
        grams = [bucket(word[i:i + n]) for n in toxicity.ORDERS for i in range(len(word) - n + 1)]
        return sum(value[g] for g in grams) / max(1, len(grams))

    def slow(text):
        words = (text or "").lower().split()
        passages = [set(words[i:i + toxicity.PASSAGE]) for i in range(0, max(1, len(words)), toxicity.PASSAGE)]
        return max(sum(map(of_word, p)) / max(1, len(p)) for p in passages) - 0.4 + 0.1

    want = [1 / (1 + np.exp(-slow(t))) for t in texts]
    assert toxicity.Model(value, -0.4, 0.1).score(pa.array(texts)) == pytest.approx(want)


def test_toxicity_without_two_classes():
    assert toxicity.train([], []).score(pa.array(["x", None])).tolist() == [0.5, 0.5]
    assert toxicity.train(["a", "b"], [0, 0]).score(pa.array(["x"]))[0] < 0.01


def test_samples_are_bounded_and_stable(spark, docs):
    rows = docs([(i, f"text {i}") for i in range(2000)])
    a, b = ({r.doc_id for r in bounded_sample(x, "doc_id", 300).collect()} for x in (rows, rows.repartition(7)))
    assert a == b and 200 < len(a) < 400
    assert bounded_sample(rows, "doc_id", 5000).count() == 2000
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)] + [(3, None)], "doc_id bigint, toxic int")
    whole, _ = labelled_texts(rows, labels, "toxic", 5000, 10**6)
    some, _ = labelled_texts(rows, labels, "toxic", 5000, 40_000)
    assert len(whole) == 1500 and 300 < len(some) < 600 and set(some) < set(whole)
    texts, y = labelled_texts(rows, labels, "toxic", 100, 10_000)
    assert 50 < len(texts) < 160 and set(y) == {0, 1}
    assert all(int(t.split()[1]) % 2 == v for t, v in zip(texts, y, strict=True))


def test_long_texts_are_learned_whole(spark, docs):
    """Neither a text's characters nor its lines are cut, and no text is passed over for its length."""
    texts = {1: "long " * 40_000 + "tail", 2: "\n".join(f"line {i}" for i in range(400)), 3: "short", 4: None}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, toxic int")
    got, y = labelled_texts(docs(list(texts.items())), labels, "toxic", 100, 1_000_000)
    assert sorted(got) == sorted(t for t in texts.values() if t) and sorted(y) == [0, 1, 1]
    one, _ = labelled_texts(docs([(1, texts[1])]), labels, "toxic", 100, 1000)
    assert one == [texts[1]]
    lines = ["Plain words stand here."] * 300 + ["@@ ## !! $$ %%"] * 100
    model = quality.train(["\n".join(lines), "Plain words stand here.\n" * 20], np.array([0, 1]))
    seen = quality.train(["\n".join(lines[:256]), "Plain words stand here.\n" * 20], np.array([0, 1]))
    assert not np.allclose(model.mean, seen.mean)  # the lines after the 256th count
