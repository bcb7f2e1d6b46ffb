import hashlib
import random
import re

import pyarrow as pa

from reelspark.llm import substring


def slow(rows):
    """doc_id -> (words, removed, digest), by the definition."""
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    least = {}
    for k, w in words:
        for i in range(len(w) - 12):
            s = tuple(w[i:i + 13])
            if k is not None:
                least[s] = min(least.get(s, k), k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if k is not None and least[tuple(w[i:i + 13])] < k:
                gone[i:i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 3)))
    shared = [[word() for _ in range(n)] for n in (13, 14, 25, 60)]
    rows = []
    for k in range(60):
        text = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(shared)[rng.randint(0, 2):]
        rows.append((k * 3 % 61, rng.choice([" ", "\n", " \t"]).join(text)))
    return rows


def test_against_the_definition(docs, spark):
    rows = _passages(1) + [(500, None), (501, ""), (None, _passages(1)[5][1]), (7, _passages(1)[7][1])]
    got = substring.substring_dedup(docs(rows).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows)


def test_small_slices(docs, monkeypatch):
    """Documents that are taken a few at a time give the same result."""
    rows = _passages(2)
    whole = substring.slices
    monkeypatch.setattr(substring, "slices", lambda b, c: whole(b, c, 100))
    got = substring.substring_dedup(docs(rows).repartition(2))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows)


def test_answers_over_batches():
    """Groups that go on over the end of a batch, one row a batch."""
    rows = [(1, 5, 0), (1, 6, 0), (1, 7, 0), (2, 1, 0), (3, 1, 9), (4, 2, 0), (4, 3, 0)]
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array([x]) for x in r], names=["k", "doc", "known"])
    out = [x for b in substring._answer_anchors(batch(r) for r in rows) for x in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(out) == sorted([(5, 1), (6, 1), (7, 1), (1, 9), (2, 5), (3, 5)])
    rows = [(1, 1, 5, 0), (1, 1, 5, 0), (1, 1, 7, 0), (1, 2, 9, 0), (2, 2, 4, 33), (3, 3, 1, 0), (3, 3, 2, 0)]
    batch = lambda r: pa.RecordBatch.from_arrays(
        [pa.array([x]) for x in r], names=["k1", "k2", "doc", "known"])
    out = [x for b in substring._answer_windows(batch(r) for r in rows) for x in zip(*b.to_pydict().values(), strict=True)]
    assert sorted(out) == [(2, 3), (4, 33), (7, 1)]


def test_odd_rows(odd, none):
    assert substring.substring_dedup(odd).count() == odd.count()
    assert substring.substring_dedup(none).count() == 0
    assert substring.replace_text(none).columns == none.columns
    same = substring.replace_text(odd)
    assert sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))


def test_text_is_replaced(docs):
    passage = " ".join(f"w{i}" for i in range(20))
    out = substring.replace_text(docs([(1, f"a\n{passage} b"), (2, f"c d\n{passage}\n  e f"), (3, "g  h")]))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1][0] == f"a\n{passage} b" and got[3] == ("g  h", 4)
    assert got[2] == ("c d\ne f", 7)
