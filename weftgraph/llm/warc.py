"""WARC archives: write captures as records, read them back and assemble transactions.

Each capture becomes three records: a request, a response (or a revisit, if an
equal payload is stored with another capture) and a metadata record. Request and
metadata name the response they belong to in ``WARC-Concurrent-To``, a revisit
names the response that it refers to in ``WARC-Refers-To``. Captures are dealt out by
their identifiers to as many files as their bytes need, so no payload, however
frequent, gathers in one task. Archives are
written, compressed, by Spark's own text writer, one record a line with the record separator
as line end, so they go to any file system and a lost task leaves no half file.
They are read as binary files, decompressed and cut by ``Content-Length`` as they are read, and joined through the
concurrent-to identifiers into one nested row for each capture.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import Staged, join_hot, shared_dir
from weftgraph.staging import remove

SEPARATOR = "\r\n\r\n"
CRLF = "\r\n"
# Bytes of payload that a file is meant for.
FILE_BYTES = 1 << 25
# What is decompressed at once.
CHUNK = 1 << 20
BATCH_BYTES = 1 << 24
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, page_id bigint, content_type string, payload_bytes bigint, "
    "payload_digest string, stored_digest string, refers_to_id string, payload binary"
)


def captures(pages: DataFrame, least_bytes: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows page_id, url, payload (binary), payload_digest (hex SHA-1), capture (identifier), first: the capture that stores an equal payload, null for a response.

    Two passes over the pages: the first keeps digests only and finds what refers
    to what; the second reads the payloads and shuffles them once. Rows repeated in page, url and payload
    are captures of their own.
    """
    payload = F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[page_id].cast("bigint").alias("page_id"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    name = lambda page, link: F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("null")), F.col("payload_digest"), link))
    rows = rows.withColumn("key", name(F.col("page_id"), F.col("url")))
    seen = Staged(rows.select("page_id", "url", "payload_digest", "key", F.octet_length("payload").cast("bigint").alias("size")), "warc-digests").df
    totals = seen.agg(F.count("*"), F.sum("size")).first()
    files = max(1, -(-(totals[1] or 0) // FILE_BYTES))
    long = seen.filter(F.col("size") >= least_bytes)
    groups = long.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("stored"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("payload_digest", F.col("stored.page_id").alias("first_page"), name(F.col("stored.page_id"), F.col("stored.url")).alias("first"))
    long = Staged(long.select("page_id", "key", "payload_digest"), "warc-long").df
    copies = join_hot(long, groups, "payload_digest", totals[0], "inner").filter(~F.col("page_id").eqNullSafe(F.col("first_page")))
    copies = Staged(copies.select(F.col("key").alias("copy"), "first").distinct(), "warc-copies").df
    dealt = rows.repartition(max(files, pages.sparkSession.sparkContext.defaultParallelism), "key")
    joined = dealt.join(copies.hint("merge"), dealt["key"] == copies["copy"], "left")
    number = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    capture = lambda key, k: F.concat_ws("-", key, k.cast("string"))
    return joined.select("page_id", "url", "payload", "payload_digest", capture(F.col("key"), number).alias("capture"), F.when(F.col("first").isNotNull(), capture(F.col("first"), F.lit(1))).alias("first"))


def _urn(digest, kind: str):
    h = F.md5(F.concat_ws("|", digest, F.lit(kind)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _record(headers: list[tuple[str, object]], body):
    """One record as text: header lines, an empty line, the block."""
    lines = [F.lit("WARC/1.1")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(SEPARATOR), body.cast("string"))


def write_archives(captured: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the records of :func:`captures` below ``path``."""
    url = F.regexp_replace("url", r"[\r\n]", "")
    response, request, meta = (_urn(F.col("capture"), k) for k in ("response", "request", "metadata"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(SEPARATOR))
    http = ("Content-Type", F.lit("application/http;msgtype=response"))
    stored = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", response), *common, digest, http], F.concat(head, F.col("payload").cast("string")))
    refers = [("WARC-Refers-To", _urn(F.col("first"), "response")), ("WARC-Profile", F.lit(REVISIT_PROFILE))]
    again = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", response), *common, digest, *refers, http], head)
    asked = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{SEPARATOR}"))
    asking = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request"))], asked)
    fields = F.concat(F.lit("pageId: "), page, F.lit(f"{CRLF}payloadBytes: "), F.octet_length("payload").cast("string"), F.lit(CRLF))
    about = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", meta), *common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], fields)
    # the outer form: no filter that makes all records once more
    records = captured.select(F.explode_outer(F.array(F.when(F.col("first").isNull(), stored).otherwise(again), asking, about)).alias("value"))
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").mode("error").text(path)


class _Unzipped(io.RawIOBase):
    """The content of an archive of one or many compressed members, a chunk at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.left = memoryview(data), 0, b""
        self.coder = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = b""
        while not got:
            if not self.left:
                if self.at >= len(self.data):
                    break
                self.left = bytes(self.data[self.at : self.at + CHUNK])
                self.at += len(self.left)
            got = self.coder.decompress(self.left, len(into))
            self.left = self.coder.unconsumed_tail
            if self.coder.eof:  # the next record may be a member of its own
                self.left = self.coder.unused_data
                self.coder = zlib.decompressobj(31)
        into[: len(got)] = got
        return len(got)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, plain or compressed."""
    stream = io.BufferedReader(_Unzipped(data), CHUNK) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record after record {at}")
        headers = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {at} is cut off")
        yield headers, block
        stream.read(len(SEPARATOR))
        at += 1


def _parsed(with_payload: bool):
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("content_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stored_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type")
        payload = digest = size = page = None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split(CRLF) if ": " in x)
            page = None if fields.get("pageId", "null") == "null" else int(fields["pageId"])
            size = int(fields["payloadBytes"])
        stored = headers.get("warc-payload-digest")
        return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), page, headers.get("content-type"), size, digest, stored and stored.removeprefix("sha1:"), headers.get("warc-refers-to"), payload if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_records(content.as_py()):
                    rows.append(row(headers, block))
                    size += 500 + (len(block) if with_payload else 0)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed(with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: response, request, metadata.

    ``response`` is the response or revisit record; the others name it in their
    concurrent-to identifier and are null where there is none. Records are read and
    shuffled once. A record without a response that it belongs to gives no row; of
    records with one identifier one is taken.
    """
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))
    shape = F.struct("record_id", "type", "target_uri", "content_type", "payload_bytes", "payload_digest", "stored_digest", "refers_to_id", "payload")
    asked = F.struct("record_id", "target_uri", "content_type")
    about = F.struct("record_id", "page_id", "payload_bytes")
    first = lambda kind, columns, name: F.first(F.when(kind, columns), True).alias(name)
    rows = records.withColumn("__w_key", key).groupBy("__w_key")
    found = rows.agg(first(main, shape, "response"), first(F.col("type") == "request", asked, "request"), first(F.col("type") == "metadata", about, "metadata"))
    return found.filter("response is not null").select("response", "request", "metadata")


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write every page, read the archives back, return page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html has an empty payload. Of equal payloads of ``least_bytes`` or more
    the one with the largest page_id is the response (pages tied there, repeated
    rows included, are all responses; a null id is below any other). A revisit's
    refers_to is the page of the response that its WARC-Refers-To names. Every row is
    returned. An empty table gives an empty result; other columns don't matter.
    The archives stay only if a ``path`` is given.
    """
    spark = pages.sparkSession
    kept, path = path, path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures(pages, least_bytes), path)
    nested = assemble(read_archives(spark, path, with_payload=False))
    rows = nested.select(
        F.col("response.record_id").alias("record_id"),
        F.col("response.refers_to_id").alias("refers_to_id"),
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.stored_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
    )
    rows = Staged(rows, "warc-rows").df
    if not kept:
        remove(spark, path)
    again = rows.filter("refers_to_id is not null")
    stored = rows.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    again = join_hot(again, stored, "refers_to_id", rows.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    others = rows.filter("refers_to_id is null").withColumn("refers_to", F.lit(None).cast("bigint"))
    return again.select(*columns).unionByName(others.select(*columns))
