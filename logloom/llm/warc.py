"""WARC records as a table of chunks.

A record is one or more rows of an archive: record, chunk number, whether it is the last, the bytes, and the
SHA-1 of the payload up to there. Rows of an archive in the order of ``place`` are a valid WARC file.
Most records are one row; an oversized payload is cut by views of its bytes, so nothing ever
copies or joins a whole record, and only rows of such records are dealt out and sorted when archives
are read. The reader feeds chunks to a parser that keeps a header and a running digest.

Of records with equal payloads the one with the smallest page_id is the response, others are
revisits. They are told by digest from narrow rows; payloads are not shuffled, unless there are more revisits
than a Bloom filter is made for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.bloom import Bloom
from logloom.llm.common import join_split, materialise

#: Bytes of a chunk.
CHUNK = 64 * 1024
_ARCHIVE = "archive int, place long, record string, chunk int, last boolean, sha1 binary, data binary"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: the response's page_id for revisits, else null.

    A page with a null id is always a response. Rows with the same id and payload are alike.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    told = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    narrow = told.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha")
    first = materialise(narrow.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most"), F.count("*").alias("n")).where("most > refers_to").drop("most"))
    revisits = materialise(join_split(narrow, first.drop("n"), ["sha"], "inner", first.select("sha", "n")).where("page_id > refers_to").distinct())
    maybe = Bloom(revisits, "page_id", revisits.count())
    # what the filter lets through, a few false positives among it, is joined exactly; all else is a response
    marked = maybe.marked(told, "page_id", "_maybe")
    sure = marked.where("not _maybe").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    rest = marked.where("_maybe").join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")
    return sure.unionAll(rest)


def write_archives(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of with_first() rows; each task writes one archive."""
    return pages.mapInArrow(lambda batches: _records(batches, chunk), _ARCHIVE)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _uri(page_id: int | None, record: str) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:x-record:{record}>"


def _head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, record: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id, record)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_uri(refers_to, '')}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _records(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    archive, place, n = TaskContext.get().partitionId(), 0, 0
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
            page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
            body = memoryview(payload.as_buffer())
            whole = hashlib.sha1(body)
            record = f"{archive}-{n}"
            n += 1
            head = _head(page_id, url, len(body), base32_sha1(whole.digest()), refers_to, record)
            if refers_to is not None:
                body = body[:0]
            cuts = list(range(0, len(body), chunk)) or [0]
            running = hashlib.sha1()
            for k, at in enumerate(cuts):
                part = body[at : at + chunk]
                running.update(part)
                data = b"".join((head if k == 0 else b"", part, b"\r\n\r\n" if k == len(cuts) - 1 else b""))
                out.append((archive, place, record, k, k == len(cuts) - 1, running.digest(), data))
                place += 1
                held += len(data)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [], 0
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["archive", "place", "record", "chunk", "last", "sha1", "data"])


class Parser:
    """One record, fed in chunks: heads are kept until they end, the payload only passes the digest."""

    def __init__(self) -> None:
        self.head = b""
        self.fields: dict[str, str] | None = None
        self.http: dict[str, str] | None = None
        self.sha1 = hashlib.sha1()
        self.left = self.seen = 0

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}

    def feed(self, data: memoryview) -> None:
        if self.http is None:
            self.head += data
            while self.http is None and (end := self.head.find(b"\r\n\r\n")) >= 0:
                fields, self.head = self._fields(self.head[:end]), self.head[end + 4 :]
                if self.fields is None:
                    self.fields, self.left = fields, int(fields["content-length"])
                else:
                    self.http = fields
                    self.left -= end + 4
            if self.http is None:
                return
            data, self.head = memoryview(self.head), b""
        self._body(data)

    def _body(self, data: memoryview) -> None:
        part = data[: self.left]
        self.sha1.update(part)
        self.seen += len(part)
        self.left -= len(part)

    def row(self) -> tuple:
        assert self.fields and self.http is not None and self.left == 0, "a record is cut off"
        told = self.fields["warc-payload-digest"].removeprefix("sha1:")
        if self.fields["warc-type"] == "response":
            assert base32_sha1(self.sha1.digest()) == told, "a payload differs from its digest"
        page = lambda uri: int(uri[len("<urn:x-page:") : -1]) if uri.startswith("<urn:x-page:") else None
        refers = self.fields.get("warc-refers-to")
        return page(self.fields["warc-record-id"]), int(self.http["content-length"]), told, self.fields["warc-type"], page(refers) if refers else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a record come one after the other."""
    parser = Parser()
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        out = []
        for last, sha1, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            parser.feed(memoryview(data.as_buffer()))
            assert parser.http is None or parser.sha1.digest() == sha1.as_py(), "a chunk differs from its running digest"
            if last.as_py():
                out.append(parser.row())
                parser = Parser()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record; a damaged one raises an error."""
    whole = archives.where("chunk = 0 and last").select("last", "sha1", "data").mapInArrow(_read, _READ)
    cut = archives.where("chunk > 0 or not last").repartition("record").sortWithinPartitions("record", "chunk").select("last", "sha1", "data").mapInArrow(_read, _READ)
    return whole.unionAll(cut)


def save(archives: DataFrame, archive: int, path: str) -> None:
    """Streams one archive to a WARC file of the driver, chunk by chunk."""
    with open(path, "wb") as out:
        for row in archives.where(F.col("archive") == archive).orderBy("place").select("data").toLocalIterator():
            out.write(row["data"])


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) to the shared folder and reads them back, one row a page.

    A null html is an empty payload. A null url leaves out the target. A null page_id is a
    response that others don't refer to. Other columns are ignored. An empty table gives an empty result.
    """
    return read_archives(materialise(write_archives(with_first(pages, min_bytes), chunk)))
