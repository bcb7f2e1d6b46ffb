import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from reelspark.functions.lineage import scratch
from reelspark.llm import warc

BIG = "x" * 1500
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9", BIG), (3, "http://a/3", "y" * 999),
    (4, "http://a/4", "y" * 999), (5, None, None), (6, "http://a/\r\nX: 1", ""), (None, "http://a/n", BIG),
    (7, "http://é/", "é\r\n\r\nWARC/1.0\r\n" * 100), (8, "u", "z" * 3_000_000),
]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 0, "s") for r in rows], "page_id bigint, url string, html string, id int, same string")


def slow(rows):
    newest = {}
    for k, _, h in rows:
        if len((h or "").encode()) >= 1000:
            newest[h] = max(x for x in (newest.get(h), k) if x is not None)
    out = []
    for k, _, h in rows:
        body = (h or "").encode()
        again = h in newest and newest[h] != k
        out.append((k, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
                    newest[h] if again else None))
    return sorted(out, key=str)


def _written(spark, rows, parts=3):
    path = scratch(spark, "warc")
    warc.write_pages(_pages(spark, rows).repartition(parts), path, least=1000)
    return path


def test_round_trip(spark):
    got = warc.read_pages(spark, _written(spark, PAGES))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(PAGES)
    assert warc.read_pages(spark, _written(spark, [])).count() == 0


def test_payloads_and_predicates(spark):
    path = _written(spark, PAGES)
    read = spark.read.format("warc")
    texts = {r.record_id: r.payload for r in read.load(path).collect()}
    assert bytes(texts["urn:page:7"]).decode() == PAGES[8][2] and texts["urn:page:1"] is None
    some = read.load(path).filter((F.col("record_type") == "response") & F.col("record_id").isin("urn:page:3", "urn:page:1"))
    assert [r.record_id for r in some.collect()] == ["urn:page:3"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "record_type" in plan
    bare = read.option("payload", "false").load(path)
    assert bare.filter("payload is not null").count() == 0
    assert {r.payload_bytes for r in bare.filter("record_id = 'urn:page:8'").collect()} == {3_000_000}


def test_headers_decide_before_payloads(spark, tmp_path, monkeypatch):
    data = warc.record("a", "response", "u", None, b"p" * 10, b"\0" * 20, "d")
    data += warc.record("b", "response", "u", None, b"q" * (9 << 20), b"\0" * 20, "d")
    data += warc.record("c", "revisit", "u", "a", b"p" * 10, b"\0" * 20, "d")
    (tmp_path / "x.warc").write_bytes(data)
    read = []
    whole = warc._Source.at
    monkeypatch.setattr(warc._Source, "at", lambda s, a, n: read.append(len(x := whole(s, a, n))) or x)
    rows = list(warc.records(str(tmp_path / "x.warc"), lambda r: r["record_id"] != "b", True))
    assert [(r["record_id"], r["payload_bytes"], r["payload"]) for r in rows] == [("a", 10, b"p" * 10), ("c", 10, None)]
    assert sum(read) < 1 << 20


def test_other_archives(spark, tmp_path):
    """Compressed files, record types without a payload, several files, files of no committed job."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    one = warc.record("a", "response", "u", None, b"body", hashlib.sha1(b"body").digest(), "d")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one))
    (tmp_path / "y.warc").write_bytes(one.replace(b"<a>", b"<z>"))
    warc.register(spark)
    rows = sorted(spark.read.format("warc").load(str(tmp_path)).collect())
    assert [(r.record_id, r.record_type, r.payload_bytes) for r in rows] == [
        ("a", "response", 4), ("i", "warcinfo", None), ("z", "response", 4)]
    (tmp_path / "manifest-1.json").write_text('["y.warc"]')
    assert [r.record_id for r in spark.read.format("warc").load(str(tmp_path)).collect()] == ["z"]


def test_broken_archives_are_told(tmp_path):
    data = warc.record("a", "response", "u", None, b"p" * 100, b"\0" * 20, "d")
    for name, part in (("cut", data[:-50]), ("no", b"junk\r\n\r\n")):
        (tmp_path / name).write_bytes(part)
        with pytest.raises(ValueError):
            list(warc.records(str(tmp_path / name), lambda r: True, True))
