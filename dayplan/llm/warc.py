"""WARC archives with an index of their records (operator 1).

Writing gives gzip archives, one member per record, and an index row per record: archive,
offset, length, URL and digest.  Reading starts from index rows: they are dealt out by
archive and offset, neighbouring byte ranges are joined to larger reads, and only those
bytes are fetched.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayplan.sources.staging import new_path, stage

#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges with at most so many other bytes between them are read together, up to a size.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
INDEX_SCHEMA = "archive string, offset bigint, length bigint, url string, payload_digest string, page_id bigint"
RECORD_SCHEMA = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string,"
    " record_type string, refers_to bigint"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and the store that Spark gives it, so that tasks open the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a qualified folder as executors open it for byte ranges; ``file:``, ``s3a:``, ``hdfs:`` and others."""
    parts = urlsplit(folder)
    if parts.scheme == "file":
        return pa.fs.LocalFileSystem(), parts.path
    return pa.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def sha1_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(text: str | None) -> str:
    """A header value on one line; what could end a line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, place: str, dated: str) -> tuple[bytes, str]:
    """One WARC record as a gzip member, and the digest of its payload.

    ``first`` is the page whose response has this payload, for a revisit of it.  ``place``, the
    archive and the offset in it, gives the record an id of its own, as pages may repeat.
    """
    digest = sha1_of(payload)
    body = b"" if first is not None else payload
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {dated}",
        f"WARC-Target-URI: {header_text(url)}" if url is not None else "",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {page_id}" if page_id is not None else "",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"X-Refers-To-Page-ID: {first}"]
    head = "\r\n".join(line for line in lines if line).encode() + b"\r\n\r\n"
    return gzip.compress(head + http + b"\r\n\r\n", 4, mtime=0), digest


def writer(folder: str, archive_bytes: int, dated: str):
    """Writes each task's records to archives of its own, and gives their index.

    Archives are named by attempt.  Those of an attempt that is lost are in no index, as
    the index rows of a task count only when the task has ended.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        task, out, size, name = TaskContext.get().partitionId(), None, 0, ""
        try:
            for batch in batches:
                rows = {field.split()[0]: [] for field in INDEX_SCHEMA.split(", ")}
                for k in range(batch.num_rows):
                    page_id, url, html, first = (batch.column(c)[k].as_py() for c in range(4))
                    if out is None or size >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, size = f"pages-{task:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    member, digest = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first, f"{name}:{size}", dated)
                    out.write(member)
                    for key, value in zip(rows, (name, size, len(member), url, digest, page_id), strict=True):
                        rows[key].append(value)
                    size += len(member)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=True)], list(rows)
                )
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, dated: str | None = None
) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` and return the index.

    Of rows with equal payloads of ``least_bytes`` or more the one with the smallest page_id
    is a response and the others revisit it; shorter payloads are always responses.  A row
    without page_id is a response, and none refers to it; rows that repeat the smallest
    page_id are all responses.  A missing html is an empty payload, a missing url stays
    missing.  Other columns are not written.  ``dated`` is the WARC-Date of all records, by
    default the time of this call.
    """
    folder = qualified(pages.sparkSession, folder)
    dated = dated or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.unhex(F.sha1(F.encode(html, "UTF-8"))).alias("sha1"),
    )
    # Only payloads that occur twice need their first page; how many these are is known
    # when the join is planned, so that pages are shuffled only if that list is large.
    counted = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= least_bytes))
    first = counted.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stage(first.filter("n > 1").select("sha1", "first"), "repeated-payloads")
    long_enough = F.octet_length("html") >= least_bytes
    revisits = F.when(long_enough & (F.col("page_id") != F.col("first")), F.col("first"))
    joined = rows.join(first, "sha1", "left").select("page_id", "url", "html", revisits.alias("first"))
    return stage(joined.mapInArrow(writer(folder, archive_bytes, dated), INDEX_SCHEMA), "warc-index")


def parse(member: bytes) -> tuple:
    """A record's fields, checked against its own digest and length."""
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (sha1_of(payload) != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    page = lambda text: int(text) if text else None
    return (
        page(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), payload if kind == "response" else None,
        int(fields["X-Payload-Length"]), digest, kind, page(fields.get("X-Refers-To-Page-ID")),
    )


def joined_ranges(ranges: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted ``(archive, offset, length)`` as reads ``(archive, start, end, parts)``."""
    archive, start, end, parts = None, 0, 0, []
    for name, offset, length in ranges:
        if parts and (name != archive or offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
            yield archive, start, end, parts
            parts = []
        if not parts:
            archive, start, end = name, offset, offset
        parts.append((offset, length))
        end = max(end, offset + length)
    if parts:
        yield archive, start, end, parts


def reader(folder: str, with_payload: bool):
    names = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        name, file = None, None
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for archive, start, end, parts in joined_ranges(ranges):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{top}/{archive}")
                data = file.read_at(end - start, start)
                found = [parse(data[offset - start : offset - start + length]) for offset, length in parts]
                columns = list(zip(*found, strict=True))
                if not with_payload:
                    columns[2] = [None] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if file is not None:
            file.close()

    return read


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` selects, by joined byte ranges.

    Payloads of revisits are missing; their length and digest come from the record.  Tasks are
    dealt by the bytes of the records, as many as a scan of that size would have: the index
    itself is far smaller.
    """
    spark = index.sparkSession
    folder = qualified(spark, folder)
    ranges = index.select("archive", "offset", "length")
    total = ranges.agg(F.sum("length").alias("n")).first().n or 0
    tasks = 1 + total // scan_bytes(spark)
    dealt = ranges.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(reader(folder, with_payload), RECORD_SCHEMA)


def scan_bytes(spark: SparkSession) -> int:
    """What a task of a scan reads at most, by the session's setting."""
    named = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(named)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to new archives, and describe the records that are read back."""
    folder = new_path(spark, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
