"""Web archives (WARC 1.1) written and read by Spark, with oversized payloads as chunks.

Writing. Of pages with equal payloads of at least `revisit_bytes`, the one with the smallest page_id is a response and the
others are revisit records that refer to it. A payload over `chunk_bytes` becomes a segmented record: a response with
segment number 1 and continuation records. Segments are cut from the Arrow buffer one at a time, so no row, line or copy holds a
whole oversized payload. Rows of text are written by Spark's text writer, one archive (gzip) for each partition, of about
`archive_bytes` at most, into any store that Spark can write.

Reading. Archives go through Spark's text reader line by line (a gzip file is one split, in order) and a small state
machine turns lines into a table of chunks: record identifier, chunk number, bytes and SHA-256 of the payload so far. The
row with `last` has the length and digest of the whole payload. Segments find their record by its identifier and must come in
order; an archive that ends within a record, or lacks one of its segments, raises an error, and so does `page_records` where a
digest differs.

Cases. Null html: empty payload. Null url: no target. Null page_id: kept, never a response to others. Repeated rows of the
smallest page_id are all responses. Payloads keep any line ends. Extra columns are not read. An empty table gives an
archive without records and an empty result.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk long, payload binary, bytes_so_far long, digest_so_far string, last boolean, intact boolean"


def record_id(page_id: int | None, digest: str, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}:{segment}'.encode()).digest()[:16])}>"


def cut(data: memoryview, size: int) -> Iterator[memoryview]:
    """data in chunks of at most about size bytes, between code points."""
    start = 0
    while len(data) - start > size:
        end = start + size
        while end > start + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[start:end]
        start = end
    yield data[start:]


def records(page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None, revisit: bool, chunk_bytes: int, date: str) -> Iterator[str]:
    """The records of a page as text, each without its last line feed."""
    own = {"X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)), "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Date": date}
    if url is not None:
        own["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if revisit:
        own |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
        yield _record("revisit", record_id(page_id, digest), own, b"", HTTP)
        return
    first, done = record_id(page_id, digest), 0
    for n, part in enumerate(cut(payload, chunk_bytes), 1):
        done += len(part)
        segment = {"WARC-Segment-Number": str(n)} if len(payload) > chunk_bytes else {}
        if n == 1:
            yield _record("response", first, own | segment, part, HTTP)
        else:
            segment["WARC-Segment-Origin-ID"] = first
            if done == len(payload):
                segment["WARC-Segment-Total-Length"] = str(done + len(HTTP))
            yield _record("continuation", record_id(page_id, digest, n), {"WARC-Date": date} | segment, part, "")


def _record(kind: str, name: str, fields: dict[str, str], body: bytes | memoryview, http: str) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": name, **fields, "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http) + len(body))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + http + str(body, "utf-8") + "\r\n\r"


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 100, chunk_bytes: int = 1 << 20, archive_bytes: int = 1 << 30, date: str | None = None) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives under path; date is that of the records (now)."""
    date = date or f"{datetime.datetime.now(datetime.UTC):%Y-%m-%dT%H:%M:%SZ}"
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # Rows without page_id, maybe many of one payload, are told apart by url.
    page = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("-"), F.xxhash64("url").cast("string")))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("key", F.concat_ws(":", "digest", page))
    heads = written(p.select("page_id", "digest", "key", F.octet_length("html").alias("bytes")), "heads")
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    archives = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / archive_bytes))
    long = heads.filter(F.col("bytes") >= revisit_bytes)
    # Only digests that occur again; the join of (page, digest) rows is narrow, so a hot payload is cheap and can be split.
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    again = long.join(first.select("digest", "refers_to"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("key", "refers_to").distinct()
    # Payloads are dealt by page, evenly, never by digest, and move once: the join goes by the same key.
    full = p.repartition(archives, "key").join(again.withColumn("revisit", F.lit(True)), "key", "left")

    def to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, html = [], 0, batch.column("html")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")), strict=True)):
                for text in records(*row[:2], memoryview(html[i].as_buffer()), *row[2:4], bool(row[4]), chunk_bytes, date):
                    out.append(text)
                    size += len(text)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = full.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(to_records, "value string")
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Reader:
    """State machine from lines (without line feed) to rows of the chunk table."""

    def __init__(self, with_payload: bool, chunk_bytes: int = 1 << 20) -> None:
        self.with_payload, self.chunk_bytes, self.size = with_payload, chunk_bytes, 0
        self.rows: list[tuple] = []
        self.part: list[bytes] = []
        self.state, self.head, self.left = "between", {}, 0
        self.record: dict | None = None
        self.open: dict[str, dict] = {}  # segmented records that wait for more

    def line(self, text: str) -> None:
        if self.state == "body":
            self._body(text.encode() + b"\n")
        elif self.state == "head":
            if text == "\r":
                self._begin()
            else:
                name, _, value = text.partition(":")
                self.head[name.lower()] = value.strip()
        elif self.state == "http":
            self.left -= len(text.encode()) + 1
            if text == "\r":
                self._enter()
        elif text.startswith("WARC/"):
            self.state, self.head = "head", {}

    def _begin(self) -> None:
        h, self.left = self.head, int(self.head["content-length"])
        kind, segment = h["warc-type"], int(h.get("warc-segment-number", 1))
        if kind == "continuation":
            origin = h.get("warc-segment-origin-id", "")
            self.record = self.open.get(origin)
            if self.record is None or segment != self.record["segments"] + 1:
                raise ValueError(f"segment {segment} of record {origin} is out of place")
            self.record["segments"] = segment
            self.state = "body"
            self._enter()
            return
        page, to = h.get("x-page-id", ""), h.get("x-refers-to-page", "")
        self.record = {"id": h["warc-record-id"], "page": int(page) if page else None, "kind": kind, "to": int(to) if to else None, "segments": 1, "chunk": 0, "bytes": 0, "sha": hashlib.sha256(), "digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "length": int(h.get("x-payload-length", 0))}
        if "warc-segment-number" in h:
            self.open[self.record["id"]] = self.record
        self.state = "http"

    def _enter(self) -> None:
        self.state, self.part, self.size = "body", [], 0
        if self.left == 0:
            self._end()

    def _body(self, data: bytes) -> None:
        """A line of a payload: a chunk is given out whenever it is full, wherever the record's writer cut."""
        data = memoryview(data)[: self.left]
        while len(data):
            piece = data[: self.chunk_bytes - self.size]
            data = data[len(piece) :]
            self.left -= len(piece)
            self.size += len(piece)
            self.record["sha"].update(piece)
            self.record["bytes"] += len(piece)
            if self.with_payload:
                self.part.append(bytes(piece))
            if self.size == self.chunk_bytes and self.left:
                self._chunk(False)
        if self.left == 0:
            self._end()

    def _chunk(self, last: bool) -> None:
        r = self.record
        r["chunk"] += 1
        payload, digest = b"".join(self.part) if self.with_payload else None, r["sha"].hexdigest()
        self.rows.append((r["id"], r["page"], r["kind"], None, r["chunk"], payload, r["bytes"], digest, last, not last or digest == r["digest"]))
        self.part, self.size = [], 0

    def _end(self) -> None:
        r = self.record
        if r["kind"] == "revisit":
            self.rows.append((r["id"], r["page"], "revisit", r["to"], 1, b"".join(self.part) if self.with_payload else None, r["length"], r["digest"], True, True))
        else:
            last = r["bytes"] == r["length"]
            self._chunk(last)
            if last:
                self.open.pop(r["id"], None)
            elif r["id"] not in self.open:
                raise ValueError(f"record {r['id']} has {r['bytes']} of {r['length']} bytes")
        self.state, self.part = "between", []

    def close(self) -> None:
        """At the end of the archives: nothing may be left open."""
        if self.state != "between" or self.open:
            raise ValueError(f"archive ends within record {self.record['id'] if self.state != 'between' and self.record else next(iter(self.open), '')}")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunk table of all archives under path: chunks of at most chunk_bytes, also of records that are in one segment.

    Lines are the units that Spark reads, so a line of a payload is held whole for a moment; records and their lines are not gathered.
    """
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("intact", pa.bool_())])

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(with_payload, chunk_bytes)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                reader.line(text)
            if reader.rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*reader.rows, strict=True), schema.types, strict=True)], schema=schema)
                reader.rows = []
        reader.close()

    return spark.read.option("lineSep", "\n").schema("value string").text(path).mapInArrow(to_chunks, CHUNKS)


def page_records(chunks: DataFrame) -> DataFrame:
    """One row for each page: page_id, payload_bytes, payload_digest, record_type, refers_to, chunks, intact (or an error)."""
    digest = F.when(F.col("intact"), F.col("digest_so_far")).otherwise(F.raise_error(F.concat(F.lit("not intact: "), "record_id")))
    return chunks.filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", F.col("chunk").alias("chunks"), "intact")
