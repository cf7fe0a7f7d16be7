"""WARC archives: written from pages, indexed, and read by byte ranges.

The index comes first: one pass over each archive gives the offset, length, URL
and digest of every record.  Selection works on the index alone.  Then the
selected records are sorted by file and offset, neighbours are coalesced to
ranges (gaps of up to ``GAP`` bytes are read through), and each range is one read.

Records are gzip members of their own, as is usual, so a range can start at any
record.  Files are opened through the file system that their URI names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docwarden.llm.base import cut, new_folder

GAP = 64 << 10
MOST_BYTES = 16 << 20
_BUFFER = 1 << 20
#: compressed bytes that a task indexes or reads, where there are more than the cores can share
TASK_BYTES = 64 << 20
_LINE_BREAKS = re.compile(r"[\r\n]+")
_DATE = "2024-01-01T00:00:00Z"
INDEX_TYPES = "file string, offset long, length long, type string, record_id string, url string, digest string"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    # the engine lists file:/a/b and file:///a/b; names may be percent-encoded
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int, url: str | None, html: str) -> bytes:
    """One response record as a gzip member."""
    body = html.encode("utf-8")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: {digest_of(body)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + _LINE_BREAKS.sub("", url).strip(" \t"))
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + http + body + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One archive a task; it gets its name when complete, so an attempt that fails leaves no archive."""
        task = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(f"{root}/pending", recursive=True)
        system.create_dir(f"{root}/archives", recursive=True)
        pending = f"{root}/pending/{task.partitionId():06d}-{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(pending) as out:
            for batch in batches:
                for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                    out.write(record_bytes(page, url, html))
                    n += 1
        if n:
            system.move(pending, f"{root}/archives/part-{task.partitionId():06d}.warc.gz")
        else:
            system.delete_file(pending)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["records"])

    return write


def write_warc(pages: DataFrame, folder: str) -> int:
    """Writes pages (page_id, url, html) as archives to ``folder``/archives and returns the number of records.

    Rows with a null id or html are left out; a null url gives a record without one.
    """
    known = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    written = known.filter("page_id is not null and html is not null").mapInArrow(_writer(folder), "records long")
    return written.agg(F.sum("records")).first()[0] or 0


def _members(source) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of the gzip members of a stream; a damaged tail ends it."""
    held, at = b"", 0
    while True:
        if not held:
            held = source.read(_BUFFER)
        if not held:
            return
        unpack, parts, used = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                if not held:
                    held = source.read(_BUFFER)
                    if not held:
                        return
                parts.append(unpack.decompress(held))
                used += len(held) - len(unpack.unused_data)
                held = unpack.unused_data
        except zlib.error:
            return
        yield at, used, b"".join(parts)
        at += used


def parse_record(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of one record; None if it isn't one."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    headers: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip(" \t")
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip(" \t")
    size = headers.get("content-length", "")
    if not size.isdigit() or int(size) > len(rest):
        return None
    return headers, rest[: int(size)]


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch["path"].to_pylist():
            system, path = _open(uri)
            rows = []
            with system.open_input_stream(path, compression=None) as source:
                for offset, length, content in _members(source):
                    record = parse_record(content)
                    if record:
                        headers = record[0]
                        rows.append((uri, offset, length, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-payload-digest")))
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["file", "offset", "length", "type", "record_id", "url", "digest"])


def _tasks(spark: SparkSession, units: int, size: int) -> int:
    """Tasks for so many units of so many bytes together: enough for all cores, more for many bytes, no more than units."""
    return max(1, min(units, max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def index_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Index of the archives in a folder; members that are no WARC records are skipped.

    A gzip file can only be read from its start, so an archive is one task's
    work; the archives are dealt to as many tasks as their bytes ask for.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # rows of paths are small, so the number of tasks is given; else adaptive execution would join them to one
    return listed.select("path").repartition(_tasks(spark, files, size)).mapInArrow(_indexer, INDEX_TYPES)


def ranges(records: list[tuple[int, int]], gap: int = GAP, most: int = MOST_BYTES) -> list[tuple[int, int, int]]:
    """Coalesces sorted (offset, length) to reads (start, end, number of records); one record may exceed ``most``."""
    out: list[tuple[int, int, int]] = []
    for offset, length in records:
        if out and offset - out[-1][1] <= gap and max(out[-1][1], offset + length) - out[-1][0] <= most:
            start, end, n = out[-1]
            out[-1] = (start, max(end, offset + length), n + 1)
        else:
            out.append((offset, offset + length, 1))
    return out


def _reader(gap: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by file and offset."""
        for batch in batches:
            files, offsets, lengths = (batch[c].to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                stop = at
                while stop < len(files) and files[stop] == files[at]:
                    stop += 1
                system, path = _open(files[at])
                with system.open_input_file(path) as source:
                    for start, end, n in ranges(list(zip(offsets[at:stop], lengths[at:stop])), gap):
                        raw = memoryview(source.read_at(end - start, start))
                        rows = []
                        for i in range(at, at + n):
                            try:
                                content = zlib.decompress(raw[offsets[i] - start : offsets[i] - start + lengths[i]], 31)
                            except zlib.error:
                                content = b""
                            record = parse_record(content)
                            if not record:
                                continue
                            headers, block = record
                            http, _, body = block.partition(b"\r\n\r\n")
                            status = http.split(b" ", 2)[1:2]
                            rows.append((headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-payload-digest"), int(status[0]) if status and status[0].isdigit() else None, body, digest_of(body) == headers.get("warc-payload-digest")))
                        at += n
                        if not rows:
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.bool_()))], names=["record_id", "url", "digest", "status", "body", "sound"])

    return read


def read_records(selected: DataFrame, *, gap: int = GAP) -> DataFrame:
    """Rows (record_id, url, digest, status, body, sound) of the index rows given; ``sound``: the digest fits the body.

    Only ``file``, ``offset`` and ``length`` of the index are used.  Defined
    cases: rows with a null among these, and ranges that hold no whole WARC
    record, give nothing; rows that repeat are read again; headers that a record
    lacks are null; an empty table gives no rows.
    """
    rows = selected.select("file", "offset", "length").filter("file is not null and offset is not null and length is not null")
    number, size = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = _tasks(selected.sparkSession, number, size)
    return rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_reader(gap), "record_id string, url string, digest string, status int, body binary, sound boolean")


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Archives the pages and reads back one record of each distinct content: rows (page_id, url, n_bytes, html_md5).

    Of equal contents the record of least page_id is selected, on the index alone.
    Defined cases: pages without an id or html are not archived; a null url stays
    null; line breaks in a url are dropped, and spaces and tabs around it; rows that repeat an id are records of
    their own (of equal content and id the first in the archives is read); an
    empty html is a content; an empty table gives no rows; other columns are not
    looked at.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    types = "page_id long, url string, n_bytes long, html_md5 string"
    if not write_warc(pages, folder):
        return spark.createDataFrame([], types)
    index = cut(index_warc(spark, f"{folder}/archives"))
    page = F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1).cast("long")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("page", "file", "offset"))
    chosen = index.filter("type = 'response'").withColumn("page", page).withColumn("place", place).filter("place = 1")
    found = read_records(chosen)
    return found.select(F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1).cast("long").alias("page_id"), "url", F.length("body").cast("long").alias("n_bytes"), F.md5("body").alias("html_md5"))
