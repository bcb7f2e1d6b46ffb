import random

import pytest

from reelspark.llm import decontaminate as dc


def slow_edits(window, text):
    """The fewest edits from the window to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def slow(rows, items):
    """(doc_id, item_id): the definition, by aligning every window with the whole text."""
    out = set()
    for item, passage in items:
        windows = dc.Windows([(item, passage)])
        for k in range(len(windows.item)):
            window = "".join(map(chr, windows.codes[k][:windows.size[k]]))
            out |= {(d, item) for d, t in rows if slow_edits(window, dc.normal(t)) <= windows.edits[k]}
    return out


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def _edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + "z" + text[i:], text[:i] + text[i + 1:], text[:i] + "z" + text[i + 1:]])
    return text


@pytest.fixture
def case():
    rng = random.Random(6)
    items = [(i, _words(rng, n)) for i, n in enumerate((10, 14, 25, 60))] + [(50, "short"), (51, None), (None, "x" * 60)]
    rows = [(i, _words(rng, 40)) for i in range(8)]
    for i, (_, passage) in enumerate(items[:4]):
        for n, edits in enumerate((0, 2, len(passage) // 20, len(passage) // 9, len(passage) // 3)):
            part = _edited(rng, passage, edits).upper().replace(" ", "  \n")
            rows.append((100 + 10 * i + n, f"{_words(rng, 15)} {part} {_words(rng, 15)}"))
        rows.append((200 + i, passage))
        rows.append((300 + i, passage[:len(passage) // 2]))
    return rows, items


def test_against_full_alignment(spark, docs, case):
    rows, items = case
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, key int")
    got = dc.find_leaks(docs(rows).repartition(3), bench)
    want = slow(rows, [x for x in items if x[0] is not None])
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 15
    kept = dc.drop_leaks(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_blocks(spark, docs, case, monkeypatch):
    rows, items = case
    monkeypatch.setattr(dc, "BLOCK_CHARS", 200)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs(rows), bench).collect()}
    assert got == slow(rows, [x for x in items if x[0] is not None])


def test_a_match_does_not_reach_over_two_texts():
    rng = random.Random(8)
    passage = _words(rng, 20)
    windows = dc.Windows([(1, passage)])
    half = len(passage) // 2
    assert windows.search([passage[:half], passage[half:]])[0].tolist() == []
    assert set(windows.search(["", passage, ""])[0].tolist()) == {1}


def test_odd_rows(spark, odd, none, docs):
    bench = spark.createDataFrame([(1, "long " * 30)], "item_id bigint, text string")
    assert {r.doc_id for r in dc.find_leaks(odd, bench).collect()} == {7}
    assert dc.find_leaks(none, bench).count() == 0
    nothing = bench.limit(0)
    assert dc.find_leaks(odd, nothing).count() == 0
    assert dc.drop_leaks(odd, nothing).count() == odd.count()
    assert dc.drop_leaks(none, bench).columns == none.columns


def test_every_excerpt(spark, docs):
    """Excerpts of 64 to 80 characters from every offset are found, against plain substrings."""
    rng = random.Random(9)
    items = [(i, _words(rng, n)) for i, n in enumerate((13, 25, 45))]
    rows = []
    for i, passage in items:
        for size in (30, 64, 65, 80):
            for o in range(max(0, len(passage) - size) + 1):
                part = passage[o:o + size]
                rows.append((len(rows), f"{_words(rng, 9)} {part.upper()} {_words(rng, 9)}", i, part))
    want = set()
    for d, text, _, _ in rows:
        text = dc.normal(text)
        pieces = {text[k:k + 64] for k in range(len(text) - 63)}
        want |= {(d, i) for i, p in items if any(p[k:k + 64] in pieces for k in range(len(p) - 63))}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.find_leaks(docs([r[:2] for r in rows]).repartition(3), bench)
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert want <= got and len(want) > 400
    assert not {d for d, _ in got} & {d for d, _, _, part in rows if len(part) == 30}


@pytest.mark.parametrize("size", [2, 7, 9, 10, 12, 13, 20, 25, 29, 37, 38, 39, 40, 55])
def test_short_items_whole(size):
    rng = random.Random(size)
    passage = "".join(rng.choices("ghijklmnopqr", k=size))
    windows = dc.Windows([(1, passage), (2, _words(rng, 30)), (3, ""), (4, None)])
    edits = size * 8 // 100
    texts = ["abc abc", f"aa{passage}bb", "", f"ab {_edited(rng, passage, edits)} ba", passage[:size // 2]]
    where, window, _ = windows.search(texts)
    got = set(where[windows.item[window] == 1].tolist())
    assert got == {k for k, t in enumerate(texts) if slow_edits(passage, t) <= edits} >= {1, 3}
