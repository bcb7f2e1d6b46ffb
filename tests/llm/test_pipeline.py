"""Each stage against a plain version of it, on documents made for the purpose."""

import random

import __spark_entry__ as entry
import corpus_pipeline as pipeline
import pytest
from test_simhash import slow_components, slow_fingerprint


def _text(rng, lines=4):
    line = lambda: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(12))
    return "\n".join(line().capitalize() + "." for _ in range(lines))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        text = _text(rng)
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad), 0))
    passage, shared = _text(rng, 2), _text(rng, 3)
    docs += [(200, docs[1][1]), (201, docs[1][1] + " end"), (202, docs[2][1] + "\n" + shared), (203, shared + "\n" + docs[3][1]),
             (204, _text(rng) + "\n" + passage), (205, None), (206, ""), (206, ""), (None, _text(rng))]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), frame


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is pipeline.run
    assert [n for n, _ in pipeline.STAGES][-1] == "best-fit packing" and len(pipeline.STAGES) == 5


def test_quality_stage(spark, corpus):
    folder, docs = corpus
    kept = pipeline.keep_quality(spark, docs, folder)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 160}
    assert good == {i for i in range(160) if i % 5}


def test_near_copy_stage(spark, corpus):
    folder, docs = corpus
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = [(k, slow_fingerprint(t)) for k, t in rows if k is not None]
    want = {k for (k, _), c in zip(known, slow_components(known), strict=True) if c == k}
    kept = pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.filter("doc_id is null").count() == 1 and kept.columns == docs.columns
    assert 200 not in want and {205, 206} & want == {205}


def test_later_stages(spark, corpus):
    folder, docs = corpus
    replaced = pipeline.drop_repeated_passages(spark, docs, folder)
    assert replaced.columns == docs.columns and replaced.count() == docs.count()
    text = {r.doc_id: r.text for r in replaced.collect()}
    assert text[1] and text[200] == "" and text[205] is None
    clean = pipeline.drop_leaks(spark, docs, folder)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert gone == {204} and clean.columns == docs.columns


def test_stages_on_an_empty_table(spark, corpus):
    folder, docs = corpus
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if stage is not pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns


def test_run(spark, corpus):
    folder, _ = corpus
    pieces = pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in pieces}
    assert 204 not in ids and 200 not in ids and {1, 2, 3} <= ids and 5 not in ids
    assert all(r.offset + r.length <= 1024 for r in pieces)


def test_near_copies_where_ids_repeat(spark, docs):
    """An id on rows with different texts: every group of copies keeps one document."""
    rng = random.Random(12)
    a, b, c, d, e = (_text(rng) for _ in range(5))
    rows = [(1, a), (2, b), (2, a), (3, c), (3, d), (3, c), (4, b), (5, e), (None, a), (None, a)]
    kept = pipeline.drop_near_copies(spark, docs(rows).repartition(3), "")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted(
        [(0, a), (0, a), (1, a), (2, b), (3, c), (3, d), (5, e)])
    assert kept.columns == docs(rows).columns
