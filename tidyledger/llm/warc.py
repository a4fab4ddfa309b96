"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

``write_arc`` writes pages as compressed ARC files, ``read_arc`` parses the header
line of the version a file declares and the declared lengths, ``convert`` makes
WARC records with identifiers, timestamps, types and digests, ``read_warc`` reads
WARC files back and checks every digest.  Files are written and listed by Spark, one
or more for each task; a file is read as a stream of records.

Null html is an empty payload, null urls become ``about:blank``.  Rows with a null
page id are kept and never chosen as the original of a revisit.  Rows that repeat a
page id: the record that comes first by (page id, archive, offset) is the response.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyledger.llm.common import thrifty
from tidyledger.session import shared_folder, stored

LEAST_REVISIT_BYTES = 100  # smaller payloads are stored again
FIRST_CAPTURE = "20200101000000"
PAGE_MARK = "#page-id="  # the page id travels in the fragment of the archived address
READ_BYTES = 4 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space

ARC_SCHEMA = (
    "version int, archive string, offset long, url string, page_id long, capture string, content_type string, "
    "payload binary, digest string, payload_bytes long"
)


# ---------------------------------------------------------------------------
# Writing ARC
# ---------------------------------------------------------------------------
def _arc_line(version: int, url: str, capture: str, kind: str, size: int, archive: str, digest: str) -> str:
    if version == 1:
        return f"{url} 127.0.0.1 {capture} {kind} {size}\n"
    return f"{url} 127.0.0.1 {capture} {kind} 200 {digest or '-'} - 0 {archive} {size}\n"


def _arc_file_header(version: int, archive: str) -> str:
    fields = "URL IP-address Archive-date Content-type "
    fields += "Archive-length" if version == 1 else "Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 tidyledger\n{fields}\n"
    line = _arc_line(version, f"filedesc://{archive}", FIRST_CAPTURE, "text/plain", len(body), archive, "")
    return line + body


def write_arc(pages: DataFrame, folder: str) -> None:
    """One compressed ARC file for each partition; partitions take turns in the version."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        version, archive = number % 2 + 1, f"part-{number:05d}.arc"
        yield _lines([_arc_file_header(version, archive)])
        for part in parts:
            out = []
            for page, url, html in zip(part.column(0), part.column(1), part.column(2), strict=True):
                body = html.as_py() or ""
                page_id = page.as_py()
                size = len(body.encode())
                reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                address = quote(url.as_py() or "about:blank", safe=":/?&=%#+,;@!$'()*~-._")
                address += PAGE_MARK + ("" if page_id is None else str(page_id))
                digest = hashlib.sha256(body.encode()).hexdigest()
                out.append(
                    _arc_line(version, address, FIRST_CAPTURE, "text/html", len(reply) + size, archive, digest)
                    + reply
                    + body
                )
            yield _lines(out)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    lines = rows.mapInArrow(thrifty(run), "value string")
    # Each value ends with the line feed that separates ARC records.
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def _lines(values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])


# ---------------------------------------------------------------------------
# Reading
# ---------------------------------------------------------------------------
def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def _records(
    files: DataFrame, schema: str, parse: Callable[[str, io.BufferedReader], Iterator[tuple]]
) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                stream = gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))
                rows, size = [], 0
                for row in parse(path.rpartition("/")[2], stream):
                    rows.append(row)
                    size += 300 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size >= READ_BYTES:
                        yield _batch(rows, names, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, types)

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]
    return files.mapInArrow(thrifty(run), schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def parse_arc(archive: str, stream) -> Iterator[tuple]:
    """Records of an ARC file.  The version block at its start says how header lines are read."""
    version, offset = None, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if line in (b"\n", b"\r\n"):
            continue
        fields = line.decode("utf-8").rstrip("\r\n").split(" ")
        size = int(fields[-1])
        body = stream.read(size)
        if len(body) < size:
            raise ValueError(f"{archive}: the record at {start} is cut off")
        offset += size
        if fields[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            continue
        if len(fields) != {1: 5, 2: 10}.get(version):
            raise ValueError(f"{archive}: the header line at {start} does not fit version {version}")
        head, _, payload = body.partition(b"\r\n\r\n")
        url, _, page = fields[0].rpartition(PAGE_MARK)
        kind = "application/http; msgtype=response" if head.startswith(b"HTTP/") else fields[3]
        digest = hashlib.sha256(payload).hexdigest()
        if version == 2 and fields[5] not in ("-", digest):
            raise ValueError(f"{archive}: the checksum at {start} does not fit")
        yield (
            version, archive, start, url, int(page) if page else None, fields[2], kind, payload, digest, len(payload),
        )


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    return _records(_files(spark, folder), ARC_SCHEMA, parse_arc)


# ---------------------------------------------------------------------------
# Converting
# ---------------------------------------------------------------------------
def record_id(archive: str, offset: int) -> str:
    """The identifier of a legacy record: the same whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}@{offset}')}>"


def _stamp(capture: str) -> str:
    """The 14 digits of an ARC date as a WARC timestamp."""
    return f"{capture[:4]}-{capture[4:6]}-{capture[6:8]}T{capture[8:10]}:{capture[10:12]}:{capture[12:14]}Z"


def _headers(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"


def convert(spark: SparkSession, arc: str, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Write the WARC files for a folder of ARC files.

    Equal payloads are met by digest with one row for each task and digest; payloads
    themselves move only to their record's role, by archive and offset.
    """
    records = read_arc(spark, arc)
    facts = stored(
        records.select("archive", "offset", "page_id", "digest", "payload_bytes"), "warc-facts"
    )
    first = F.min(F.struct("page_id", "archive", "offset")).alias("first")
    known = facts.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = known.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "first")
    roles = facts.where(F.col("payload_bytes") >= least_bytes).join(firsts, "digest")
    roles = roles.where(
        ~((F.col("archive") == F.col("first.archive")) & (F.col("offset") == F.col("first.offset")))
    ).select("archive", "offset", F.col("first").alias("original"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.warc"
        info = "software: tidyledger\r\nformat: WARC File Format 1.1\r\n"
        fields = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", record_id(name, -1)),
            ("WARC-Date", _stamp(FIRST_CAPTURE)),
            ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"),
            ("Content-Length", len(info)),
        ]
        yield _lines([_headers(fields) + info + "\r\n\r"])
        for part in parts:
            out = []
            for row in part.to_pylist():
                original, size = row["original"], row["payload_bytes"]
                reply = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
                fields = [
                    ("WARC-Type", "revisit" if original else "response"),
                    ("WARC-Record-ID", record_id(row["archive"], row["offset"])),
                    ("WARC-Date", _stamp(row["capture"])),
                    ("WARC-Target-URI", row["url"]),
                    ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
                    ("X-Payload-Length", size),
                    ("X-Page-Id", "" if row["page_id"] is None else row["page_id"]),
                ]
                body = "" if original else row["payload"].decode("utf-8")
                if original:
                    fields += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", record_id(original["archive"], original["offset"])),
                        ("X-Refers-To-Page-Id", original["page_id"]),
                    ]
                length = len(reply) + (0 if original else size)
                fields += [("Content-Type", row["content_type"]), ("Content-Length", length)]
                # The line separator adds the last line feed of CR LF CR LF.
                out.append(_headers(fields) + reply + body + "\r\n\r")
            yield _lines(out)

    whole = records.join(roles, ["archive", "offset"], "left").select(
        "archive",
        "offset",
        "url",
        "page_id",
        "capture",
        "content_type",
        F.when(F.col("original").isNull(), F.col("payload")).alias("payload"),
        "digest",
        "payload_bytes",
        "original",
    )
    lines = whole.mapInArrow(thrifty(run), "value string")
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(folder)


WARC_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_record string, url string, warc_date string, payload binary"
)


def parse_warc(archive: str, stream) -> Iterator[tuple]:
    """Response and revisit records of a WARC file; a payload that misses its digest is an error."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{archive}: no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.lower()] = value.strip()
        body = stream.read(int(fields["content-length"]))
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        payload = body.partition(b"\r\n\r\n")[2]
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{archive}: the payload of {fields['warc-record-id']} misses its digest")
        number = lambda key: int(fields[key]) if fields.get(key) else None
        size = len(payload) if kind == "response" else number("x-payload-length")
        yield (
            number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), fields["warc-record-id"],
            fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"],
            payload if kind == "response" else None,
        )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    return _records(_files(spark, folder), WARC_SCHEMA, parse_warc)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
