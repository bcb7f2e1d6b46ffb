"""WARC archives as a Python data source.

``format("warc")`` reads and writes folders of ``.warc`` files. Reading plans a
partition per file, takes predicates on record type and header fields down to
the parser, parses a record's headers first and only then, for a record that is
wanted, its payload; the bytes of others are skipped. Writing adds files below
a folder; a manifest names those of committed jobs, so files of lost or
repeated tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from reelspark.llm.common import cut

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_sha1 string, payload_bytes bigint, payload binary"
)
#: Columns that come from the headers, so that predicates on them need no payload.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_sha1")
MANIFEST = "manifest-"
#: Bytes after which a task starts another file, read at a time, and given out at a time.
FILE_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 1 << 20, 8 << 20
# Fixed values of the format.
VERSION = b"WARC/1.0"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAYLOAD_TYPES = ("response", "revisit", "resource", "conversion")
NAMES = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, record_type: str, target_uri: str, refers_to: str | None, payload: bytes,
           sha1: bytes, date: str) -> bytes:
    """One record; a revisit has the HTTP headers, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = payload if record_type == "response" else b""
    head = [
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{_line(record_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(target_uri)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{_line(refers_to or '')}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    top = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n"
    return top + http.encode() + body + b"\r\n\r\n"


@dataclass
class Files(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.date = options["path"], options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator) -> Files:
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                # Row by row, so that one decoded payload is held at a time.
                columns = [batch.column(batch.schema.get_field_index(c)) for c in
                           ("record_id", "record_type", "target_uri", "refers_to", "payload")]
                for values in zip(*columns, strict=True):
                    key, kind, uri, refers, payload = (v.as_py() for v in values)
                    payload = payload or b""
                    data = record(key, kind, uri or "", refers, payload, hashlib.sha1(payload).digest(), self.date)
                    if out is None or size + len(data) > FILE_BYTES and size:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc")
                        out, size = fs.open_output_stream(posixpath.join(folder, names[-1])), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Files(names)

    def commit(self, messages):
        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        with fs.open_output_stream(posixpath.join(folder, f"{MANIFEST}{uuid.uuid4().hex}.json")) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages):
        fs, folder = _open(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(posixpath.join(folder, name))


class _Source:
    """Bytes of a file by position; what is skipped is not read (or, in a
    compressed file, decompressed but not kept)."""

    def __init__(self, path: str):
        fs, name = _open(path)
        if name.endswith(".gz"):
            self.file = gzip.GzipFile(fileobj=fs.open_input_file(name))
        else:
            self.file = fs.open_input_file(name)
        self.start, self.held = 0, b""

    def at(self, start: int, n: int) -> bytes:
        """``n`` bytes from ``start`` on, fewer at the end of the file."""
        if not self.start <= start or start + n > self.start + len(self.held):
            self.file.seek(start)
            self.start, self.held = start, self.file.read(max(n, READ_BYTES))
        return self.held[start - self.start:start - self.start + n]

    def until(self, start: int, mark: bytes) -> bytes:
        """From ``start`` up to and with ``mark``; empty if it does not come."""
        n = 4096
        while True:
            got = self.at(start, n)
            end = got.find(mark)
            if end >= 0:
                return got[:end + len(mark)]
            if len(got) < n:
                return b""
            n *= 2


def _headers(block: bytes) -> dict[str, str]:
    """The named fields of a header block, names in lower case, continuation lines joined."""
    text = re.sub(r"\r?\n[ \t]+", " ", block.decode("utf-8", "replace"))
    fields = (line.partition(":") for line in re.split(r"\r?\n", text)[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in fields if colon}


def records(path: str, wanted, with_payload: bool):
    """The records of one file whose header columns satisfy ``wanted``, as dicts."""
    source, pos = _Source(path), 0
    while True:
        while source.at(pos, 2) == b"\r\n":
            pos += 2
        block = source.until(pos, b"\r\n\r\n")
        if not block:
            if source.at(pos, 1).strip():
                raise ValueError(f"{path}: no complete header at byte {pos}")
            return
        if not block.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record at byte {pos}")
        head = _headers(block)
        start, size = pos + len(block), int(head.get("content-length", 0))
        pos = start + size
        row = {c: head.get(n) for c, n in NAMES.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] is not None else None
        method, _, digest = head.get("warc-payload-digest", "").partition(":")
        row["payload_sha1"] = base64.b32decode(digest).hex() if method.lower() == "sha1" else None
        if not wanted(row):
            continue
        row["payload_bytes"] = row["payload"] = None
        if row["record_type"] in PAYLOAD_TYPES:
            http = head.get("content-type", "").startswith("application/http")
            inner = source.until(start, b"\r\n\r\n") if http else b""
            inner = inner if len(inner) <= size else b""
            length = _headers(inner).get("content-length") if inner else None
            row["payload_bytes"] = int(length) if length and length.isdigit() else size - len(inner)
            if with_payload and row["record_type"] != "revisit":
                row["payload"] = source.at(start + len(inner), size - len(inner))
                if len(row["payload"]) < size - len(inner):
                    raise ValueError(f"{path}: the record before byte {pos} is cut off")
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.allowed: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Takes equality and membership on header columns; gives back the rest."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[-1]
            if name in HEADER_COLUMNS and isinstance(f, EqualTo | EqualNullSafe):
                self.allowed.append((name, (f.value,)))
            elif name in HEADER_COLUMNS and isinstance(f, In):
                self.allowed.append((name, tuple(f.value)))
            elif name in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.allowed.append((name, ()))
            else:
                yield f

    def partitions(self):
        fs, folder = _open(self.path)
        info = fs.get_file_info(folder)
        if info.type == pafs.FileType.File:
            return [InputPartition(self.path)]
        found = fs.get_file_info(pafs.FileSelector(folder))
        listed = [x.path for x in found if x.base_name.startswith(MANIFEST)]
        names = []
        for path in listed:
            with fs.open_input_stream(path) as f:
                names += json.loads(f.read())
        if not listed:
            names = sorted(x.base_name for x in found if re.search(r"\.warc(\.gz)?$", x.base_name))
        return [InputPartition(posixpath.join(self.path, n)) for n in sorted(names)] or [InputPartition(None)]

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None if not values else row[c] in values for c, values in self.allowed)

    def read(self, partition):
        if partition.value is None:
            return
        kind = pa.schema([
            *((c, pa.string()) for c in HEADER_COLUMNS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for row in records(partition.value, self.wanted, self.with_payload):
            rows.append(row)
            size += len(row["payload"] or b"") + 256
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``; option payload=false leaves payloads out."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("archives are only added to; write to a new folder")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least: int, key: str = "page_id", url: str = "url",
                html: str = "html") -> None:
    """Write a record per row of ``pages``, its payload the text of ``html`` in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least`` bytes, that with the
    largest key becomes a response and the others revisits that refer to it;
    every other row is a response. Rows that repeat the largest key are all
    responses; a null key is below all others. A null url is empty.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    rows = rows.withColumn("same", F.when(F.length("payload") >= least, digest))
    groups = rows.filter("same is not null").groupBy("same").agg(
        F.max("id").alias("newest"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur twice; Spark broadcasts them if the written table is small.
    repeated = cut(groups.filter("n > 1").select("same", "newest"))
    revisit = F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("id"))
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    out = rows.join(repeated, "same", "left").select(
        urn.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("newest").cast("string"))).alias("refers_to"), "payload",
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives that ``write_pages`` made.

    Digests of responses are computed from the payload read; a revisit's is in
    its header, and its file is passed over without decoding any payload.
    """
    register(spark)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("bigint")
    full = spark.read.format("warc").load(path).filter("record_type = 'response'")
    bare = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    full = full.withColumn("payload_bytes", F.length("payload").cast("bigint"))
    full = full.withColumn("payload_sha1", F.sha1("payload"))
    return full.drop("payload").union(bare.drop("payload")).select(
        number("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
