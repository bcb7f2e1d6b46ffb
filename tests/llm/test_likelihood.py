import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from reelspark.llm import likelihood
from reelspark.llm.queries import QUERIES

BUCKETS = 512


def _words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def _hash(text, seed=42):
    h = xxhash.xxh64_intdigest(text.encode() if isinstance(text, str) else text, seed=seed)
    return h


def _bucket(h):
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def _long(h, seed):
    return xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=seed)


def grams(text):
    w = _words(text)
    h = [_hash(x) for x in w]
    ends = [_hash(x[-3:], _hash("end")) for x in w]
    pairs = [_long(b, _long(a, 42)) for a, b in zip(h, h[1:], strict=False)]
    return [_bucket(x) for x in h + ends + pairs]


def base(text):
    w = _words(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if _words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again))


def slow(rows, trusted, least):
    raw, good = Counter(g for _, t in rows for g in grams(t)), Counter(g for t in trusted for g in grams(t))
    r, t = sum(raw.values()) + BUCKETS, sum(good.values()) + BUCKETS
    ratio = [math.log((good[b] + 1) / t) - math.log((raw[b] + 1) / r) for b in range(BUCKETS)]
    out = []
    for key, text in rows:
        own, sizes = grams(text), base(text)
        score = sum(ratio[g] for g in own) / len(own) if own else 0.0
        failed = sizes[0] < 50 or 100 * sizes[4] > 50 * sizes[0]
        out.append((key, *sizes, failed, score, not failed and score >= least))
    return out


def _text(rng, junk=False):
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["", "x", "yz", "é"])
                            + ("##" if junk else "") for _ in range(rng.randint(0, 25)))
    lines = [line() for _ in range(6)]
    return rng.choice("\n\n\t").join(lines + ([lines[0], lines[2]] if rng.random() < 0.5 else []))


def _check(got, want):
    assert sorted(map(repr, (r[:7] + r[8:] for r in got))) == sorted(map(repr, (r[:7] + r[8:] for r in want)))
    for a, b in zip(sorted(got, key=lambda r: repr(r[:7])), sorted(want, key=lambda r: repr(r[:7])), strict=True):
        assert a[7] == pytest.approx(b[7], abs=1e-9)


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    rows = [(i, _text(rng, i % 5 == 0)) for i in range(60)]
    rows += [(100, " ".join(f"w{i % 50}" for i in range(400))), (101, " ".join(f"w{i}" for i in range(70)) + " w0 w1 w2")]
    frame = docs(rows)
    trusted = [t for i, t in rows if i % 5 and i < 40]
    ratio = likelihood.fit(frame, frame.filter("doc_id % 5 <> 0 and doc_id < 40"), buckets=BUCKETS)
    got = likelihood.quality_rules(frame, ratio, least=0.0, buckets=BUCKETS)
    want = slow(rows, trusted, 0.0)
    _check([tuple(r) for r in got.collect()], want)
    assert {r[-1] for r in want} == {True, False} and any(r[6] for r in want)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    ratio = likelihood.fit(odd, none, buckets=BUCKETS)
    _check([tuple(r) for r in likelihood.quality_rules(odd, ratio, buckets=BUCKETS).collect()], slow(rows, [], likelihood.LEAST))
    empty = likelihood.fit(none, none, buckets=BUCKETS)
    assert likelihood.quality_rules(none, empty, buckets=BUCKETS).count() == 0
    assert spark.range(1).select(F.array_max(empty), F.size(empty)).first() == (0.0, BUCKETS)


def test_windows_beyond_the_list(spark, docs):
    rng = random.Random(4)
    many = [f"w{i}" for i in range(300)]
    texts = [" ".join(many + ["gap"] + many[:n]) for n in (2, 3, 30, 35, 299)] + [" ".join(rng.choices("ab", k=200))]
    frame = docs(list(enumerate(texts)))
    rows = frame.select("doc_id", likelihood.words(F.col("text")).alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    got = likelihood.with_repeated_words(rows, "h", "n")
    assert {r.doc_id: r.n for r in got.collect()} == {i: base(t)[4] for i, t in enumerate(texts)}


def test_plan_is_native(spark, docs, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(likelihood, "cut", seen)
    frame = spark.range(3).selectExpr("id as doc_id", "'a b c' as text")
    likelihood.quality_rules(frame, likelihood.fit(frame, frame))
    assert plans and not any(re.search("Python|Arrow|Pandas|Exchange", p) for p in plans)


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not there")
def test_verdicts_on_the_given_tables(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES["op12_quality_rules"](spark, FOLDER).filter("not base_failed").join(labels, "doc_id").collect()
    assert len(rows) > 100 and sum(r.kept == (r.quality == 1) for r in rows) >= 0.99 * len(rows)


def test_every_trusted_text_counts(spark, monkeypatch, tmp_path):
    """Also those beyond what was once a bound on the ids, and whatever the table of bits says."""
    from reelspark.llm import queries
    from reelspark.llm.common import having

    docs = spark.range(400).selectExpr("if(id = 7, null, id) doc_id", "concat('w', id) text")
    good = docs.select("doc_id").filter("doc_id % 3 = 0 or doc_id is null").unionByName(docs.select("doc_id").filter("doc_id = 9"))
    want = {i for i in range(400) if i % 3 == 0}
    for bits in (64, 1 << 16):
        got = [r.doc_id for r in having(docs, good, "doc_id", bits).collect()]
        assert sorted(got) == sorted(want)
    labels = spark.range(400).selectExpr("id doc_id", "1 quality", "0 toxic")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    fit = queries.likelihood.fit
    monkeypatch.setattr(queries.likelihood, "fit", lambda raw, trusted: seen.append(trusted.count()) or fit(raw, trusted))
    queries.QUERIES["op12_quality_rules"](spark, str(tmp_path)).count()
    assert seen == [399]
