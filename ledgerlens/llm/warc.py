"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage
from .ordering import small_lookup

DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 32 << 20  # an archive is closed by the record that reaches them
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")  # of a member, or a version line
HEADER_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")  # the blank line, or the version line of another record
CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
PIECE = 1 << 16
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    """Name of a record: pages that share an id but not the payload have names of their own."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """Bytes of one record, without the two line ends that close it."""
    sha1 = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}",
             f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block


def member(data: bytes) -> bytes:
    """One gzip member that holds a whole record."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data + END) + packer.flush()


def page_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit): which page of equal payloads is the response.

    Payload is the html in UTF-8; null counts as empty. Of equal payloads of at least ``least_bytes`` the page with the
    largest page_id is the response and the others revisit it; rows that repeat that page_id with the same payload are
    responses too. A null page_id is smaller than any other; if there is no other, all are responses. Only digests that
    occur twice are looked up, so pages are not shuffled while those are few, and salted where they are many.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    sizes = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(
        F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n"))
    shared = stage(sizes.filter("n > 1 and latest is not null").select("sha1", "latest"), "payloads")
    met = small_lookup(rows, shared, "sha1")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return met.select("page_id", "url", "payload", F.when(revisit, F.col("latest")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record for each page into plain archives under ``path``.

    A task packs records into archives of ``archive_bytes``, which only the last record may exceed, so an archive stays
    far below the largest row whatever the length of pages. Spark's text writer commits the files, one row in each, so
    lost or repeated tasks leave none behind, on any file system it knows. Its line separator is the two line ends that
    close a record.
    """
    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit")]
            for row in zip(*cols):
                held.append(record(*(v.as_py() for v in row)))
                size += len(held[-1]) + len(END)
                if size >= archive_bytes:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    def archive(records):
        return pa.RecordBatch.from_arrays([pa.array([END.join(records)], pa.binary())], ["archive"])

    archives = page_roles(pages, least_bytes).mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string")).write.option("lineSep", END.decode()).option(
        "maxRecordsPerFile", 1).text(path)


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place; ValueError if it is damaged or cut off."""
    unpacker, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and pos < len(data):
            parts.append(unpacker.decompress(data[pos:pos + PIECE]))
            pos = min(pos + PIECE, len(data))
    except zlib.error as e:
        raise ValueError("damaged member") from e
    if not unpacker.eof:
        raise ValueError("member is cut off")
    return b"".join(parts), pos - len(unpacker.unused_data)


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Headers (lower-case names), block and end of the record at a place; ValueError if a check fails."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    found = HEADER_END.search(data, at)
    if not found or found.group() != END:
        raise ValueError("header has no end")
    stop = found.start()
    if CONTROL.search(data, at, stop):
        raise ValueError("control byte in header")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or "warc-type" not in headers or "warc-record-id" not in headers:
        raise ValueError("header lacks a needed field")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != END:
        raise ValueError("record does not end where it should")
    block = data[start:end]
    if mismatch(headers.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    if headers["warc-type"] in ("response", "resource") and mismatch(headers.get("warc-payload-digest"), payload_of(headers, block)):
        raise ValueError("payload digest differs")
    return headers, block, end + 4


def mismatch(said: str | None, data: bytes) -> bool:
    return bool(said) and said.lower().startswith("sha1:") and said[5:].upper() != digest(data)


def payload_of(headers: dict, block: bytes) -> bytes:
    """The body behind the HTTP header of a response, else the whole block."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(END)[2]
    return block


def salvage(data: bytes):
    """Records and gaps of an archive of plain records, gzip members or both, in order.

    Yields ("record", start, length, headers, block) and ("gap", start, length, reason, None). After a failed check the
    search goes on at the next place that looks like a member or a version line and passes all checks; the bytes up to
    it are one gap, with the reason of the first failure. A damaged record that holds a whole record in its own block
    gives that one.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b", at):
                content, end = inflate(data, at)
                headers, block, used = parse(content, 0)
                if used != len(content):
                    raise ValueError("member holds more than a record")
            else:
                headers, block, end = parse(data, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            found = START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why, None
            gap = None
        yield "record", at, end - at, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, None


SCHEMA = ("file string, kind string, start long, length long, reason string, record_type string, record_id string, refers_to "
          "string, page_id long, target_uri string, payload_bytes long, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record and each quarantined gap (``kind``) of all archives under ``path``.

    Archives are read through Spark's own reader, one archive at a time in a task; an archive must fit in a row (2 GB;
    those of ``write_archives`` do).
    Empty archives give no rows. Payload length and digest are those of the bytes read; a revisit has the digest its
    header states and no length until it is resolved.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for kind, start, length, headers, block in salvage(content.as_py() or b""):
                    if kind == "gap":
                        rows.append([file, kind, start, length, headers] + [None] * 8)
                    else:
                        rows.append([file, kind, start, length, None, *fields(headers, block, with_payload)])
                    if len(rows) == 500:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(),
                 pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def fields(headers: dict, block: bytes, with_payload: bool) -> list:
    kind, page = headers["warc-type"], headers.get("x-page-id", "")
    body = payload_of(headers, block) if kind != "revisit" else None
    said = headers.get("warc-payload-digest", "")
    return [kind, headers["warc-record-id"], headers.get("warc-refers-to"),
            int(page) if re.fullmatch("-?[0-9]{1,19}", page) and -1 << 63 <= int(page) < 1 << 63 else None, headers.get("warc-target-uri"),
            None if body is None else len(body), digest(body) if body is not None else said[5:].upper() or None,
            body if with_payload else None]


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the payload length and the page of the response that it refers to.

    ``records`` is a stored table. Only responses that are referred to enter the lookup. A revisit whose response is
    lost keeps its stated digest, without length and page.
    """
    rows = records.filter("kind = 'record'").select("record_type", "record_id", "refers_to", "page_id", "payload_bytes", "payload_digest")
    revisits, others = rows.filter("record_type = 'revisit'"), rows.filter("record_type <> 'revisit'")
    wanted = revisits.filter("refers_to is not null").select(F.col("refers_to").alias("r")).distinct()
    found = others.join(wanted, F.col("record_id") == F.col("r"), "left_semi").groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("page_id").alias("first_page"), F.max("payload_bytes").alias("bytes"))
    met = small_lookup(revisits, stage(found, "responses"), "refers_to")
    return others.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        met.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_page").alias("refers_to")))
