"""WARC archives with a two-level capture index.

Records are written as one gzip member each, so a record can be read by its byte range.
Every capture has an index line: reversed-host URL key, page id, file, offset, length.
Lines are sorted by key and packed into compressed blocks, and a sparse directory keeps
the first key of each block with the block's own byte range; a look-up searches the
directory, reads one block, searches its lines and reads one record.  ``CaptureIndex`` does
that for single URLs on one machine, ``look_up`` for a table of keys: each key goes to the
index files whose range of keys holds it, and a file's keys meet the file's part of the
directory in one task.  The driver sees the first and last key of each index file.

Files are written by executors into a folder that driver and executors share, through
pyarrow's file systems (local mounts, HDFS, object stores), each under a name of its own;
only files named by rows of the task attempt that Spark committed count, so a lost
executor leaves at most unused files behind.

Of records with equal payloads of at least ``min_bytes`` bytes that with the largest page id
is the response and the others revisit it; smaller payloads are all responses.  Payloads are
taken as equal if SHA-1 and SHA-256 are.  A payload is held whole by the task that writes
or reads its record.  A null html
is an empty payload.  Null page ids come before all others.  Of rows that share an id and a
payload the one with the largest URL hash is the response; rows that repeat it wholly are
responses too.  Null URLs have the empty key.  An empty table gives no files, an empty index and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, shared_dir, shuffle_partitions, small_batches

MIN_BYTES = 0
LEVEL = 3
#: Lines in one block of the index, and bytes of records in one archive file.
BLOCK_LINES, FILE_BYTES = 1024, 256 << 20
#: Bytes of records that one task is to read back.
TASK_BYTES = 64 << 20
#: The date of every record: pages carry none, and equal inputs should give equal archives.
DATE = "1970-01-01T00:00:00Z"
CRLF = b"\r\n"


def file_system(path: str):
    """A pyarrow file system and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def url_key(url: str | None) -> str:
    """Reversed host, port and path of a URL, lower case, without blanks and controls: com,example,www)/path?query."""
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", _url_key(url))


def _url_key(url: str | None) -> str:
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    usual = {"http": 80, "https": 443}.get(parts.scheme)
    key = ",".join(reversed(labels)) + (f":{port}" if port and port != usual else "") + ")"
    return key + (parts.path.rstrip("/") or "/") + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, refers_to: int | None, size: int) -> bytes:
    """One record: a response that holds the payload, or (payload None) a revisit that refers to one."""
    head = {
        "WARC-Type": "revisit" if payload is None else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if payload is None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + CRLF + block + CRLF + CRLF


def pack(record: bytes) -> bytes:
    """A gzip member without a time stamp."""
    return gzip.compress(record, LEVEL, mtime=0)


@dataclass
class Record:
    page_id: int | None
    kind: str
    url: str
    digest: str
    refers_to: int | None
    size: int
    payload: bytes | None


def page_of(text: str) -> int | None:
    value = text.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def parse_record(member: bytes) -> Record:
    """The record of one gzip member; raises ValueError if it is cut short or its digest is wrong."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(CRLF + CRLF)
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(CRLF + CRLF)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != size or payload_digest(body) != digest):
        raise ValueError("payload does not match its record")
    refers_to = page_of(fields["WARC-Refers-To"]) if revisit else None
    return Record(page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], fields["WARC-Target-URI"], digest, refers_to, size, None if revisit else body)


def planned(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Every page with what its record is to be; the payload only where it is written."""
    small_batches(pages.sparkSession)
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"),
    )
    size = F.length("payload").cast("long")
    marked = slim.select("page_id", "url", size.alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.xxhash64("url").alias("tie"), "payload")
    large = marked.where(F.col("size") >= min_bytes)
    # One row for each payload, combined before the exchange and written, so that a frequent payload's join can be split.
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "tie"))
    newest = materialise(large.groupBy("sha1", "sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "newest")
    revisits = (
        F.col("best").isNotNull()
        & (F.col("size") >= min_bytes)
        & ~((F.coalesce("page_id", F.lit(-(1 << 63))) == F.col("best.id")) & (F.col("tie") == F.col("best.tie")))
    )
    joined = marked.join(newest, ["sha1", "sha256"], "left")
    refers = F.when(F.col("best.id") != -(1 << 63), F.col("best.id"))
    return joined.select(
        "page_id", "url", "size", "sha1", revisits.alias("revisit"), F.when(revisits, refers).alias("refers_to"), F.when(~revisits, F.col("payload")).alias("payload")
    )


DIRECTORY = "first_key string, last_key string, file string, offset long, length int, lines int, bytes long"
DIRECTORY_FIELDS = [f.split()[0] for f in DIRECTORY.split(", ")]
CAPTURE = "key string, page_id long, file string, offset long, length int"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a record for every page into archives in folder; returns the written table of captures."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, size, sha1, revisit, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = pack(build_record(page_id, url, digest, None if revisit else payload, refers_to, size))
                    if out is None or offset > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, offset, len(member)))
                    offset += len(member)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    return materialise(planned(pages, min_bytes).mapInArrow(write, CAPTURE), "captures")


def line_of(row: tuple) -> str:
    key, page_id, file, offset, length = row
    return "\t".join([key, "" if page_id is None else str(page_id), file, str(offset), str(length)])


def row_of(line: str) -> tuple[str, int | None, str, int, int]:
    key, page_id, file, offset, length = line.split("\t")
    return key, int(page_id) if page_id else None, file, int(offset), int(length)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures by key into compressed blocks; returns the directory (first_key, last_key, file, offset, length, lines, bytes).

    bytes: those of the records that a block lists.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        out, name, offset, waiting = None, "", 0, []
        entries: list[tuple] = []

        def flush(lines: list[str]) -> None:
            nonlocal out, name, offset
            if out is None:
                name = f"{uuid.uuid4().hex}.cdx.gz"
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            block = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6, mtime=0)
            out.write(block)
            entries.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], name, offset, len(block), len(lines), sum(row_of(x)[4] for x in lines)))
            offset += len(block)

        try:
            for batch in batches:
                waiting += map(line_of, zip(*(c.to_pylist() for c in batch.columns), strict=True))
                while len(waiting) >= BLOCK_LINES:
                    flush(waiting[:BLOCK_LINES])
                    del waiting[:BLOCK_LINES]
            if waiting:
                flush(waiting)
        finally:
            if out is not None:
                out.close()
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        if entries:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*entries, strict=True), kinds, strict=True)], DIRECTORY_FIELDS)

    # Ties of one key may span partitions: the page id is part of the order, so a hot key is dealt over many.
    ordered = captures.repartitionByRange(shuffle_partitions(captures), "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return materialise(ordered.mapInArrow(blocks, DIRECTORY), "directory")


def read_range(system, base: str, file: str, offset: int, length: int) -> bytes:
    with system.open_input_file(f"{base}/{file}") as f:
        return f.read_at(length, offset)


class CaptureIndex:
    """Look-ups on one machine: the sparse directory in memory, blocks and records by range reads."""

    def __init__(self, directory: list[tuple], folder: str):
        self.directory = sorted(directory)
        self.system, self.base = file_system(folder)
        self.firsts = [r[0] for r in self.directory]
        self.held: tuple | None = None

    @classmethod
    def load(cls, directory: DataFrame, folder: str) -> CaptureIndex:
        """The directory has one row for BLOCK_LINES captures; it is meant for tables of up to some billions of pages."""
        return cls([tuple(r)[:5] for r in directory.collect()], folder)

    def captures(self, url: str) -> list[tuple[str, int | None, str, int, int]]:
        return list(self.search(url_key(url)))

    def search(self, key: str) -> Iterator[tuple[str, int | None, str, int, int]]:
        """Captures of a key: binary search in the directory, then in the lines of each block that may hold it."""
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.directory) and self.firsts[at] <= key:
            if self.directory[at][1] >= key:
                lines, keys = self.block(at)
                k = bisect.bisect_left(keys, key)
                while k < len(lines) and keys[k] == key:
                    yield row_of(lines[k])
                    k += 1
            at += 1

    def block(self, at: int) -> tuple[list[str], list[str]]:
        """Lines and keys of a block; the last one read is remembered."""
        if self.held is None or self.held[0] != at:
            _, _, file, offset, length = self.directory[at]
            lines = zlib.decompress(read_range(self.system, self.base, file, offset, length), 31).decode("utf-8", "surrogatepass").split("\n")
            self.held = at, lines, [x.split("\t", 1)[0] for x in lines]
        return self.held[1:]

    def records(self, url: str) -> list[Record]:
        return [parse_record(read_range(self.system, self.base, f, o, n)) for _, _, f, o, n in self.captures(url)]


CAPTURE_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
CAPTURE_FIELDS = ["key", "page_id", "file", "offset", "length"]


def look_up(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """CAPTURE rows of every key of keys (key string, without repetitions), by way of the directory."""
    ranges = [tuple(r) for r in directory.groupBy("file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).select("a", "b", "file").collect()]
    ranges.sort()
    sent = keys.sparkSession.sparkContext.broadcast(ranges)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [a for a, _, _ in sent.value]
        for batch in batches:
            files, wanted = [], []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_right(firsts, key) - 1
                # Index files cover ranges of keys one after the other; only a frequent key is in several.
                while at >= 0 and sent.value[at][1] >= key:
                    files.append(sent.value[at][2])
                    wanted.append(key)
                    at -= 1
            yield pa.record_batch([pa.array(files, pa.string()), pa.array(wanted, pa.string())], ["file", "key"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        index = CaptureIndex(list(zip(*(right.column(k).to_pylist() for k in DIRECTORY_FIELDS[:5]), strict=True)), folder)
        rows = [r for key in sorted(left.column("key").to_pylist()) for r in index.search(key)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, CAPTURE_KINDS, strict=True)], CAPTURE_FIELDS)

    routed = keys.mapInArrow(route, "file string, key string")
    return routed.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(search, CAPTURE)


def read_back(captures: DataFrame, folder: str, n_bytes: int = 0) -> DataFrame:
    """Every record of captures, by range reads, file by file; n_bytes: those of all records.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to, key.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        name, handle = None, None
        try:
            for batch in batches:
                rows = []
                for key, file, offset, length in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                    if file != name:
                        if handle is not None:
                            handle.close()
                        name, handle = file, system.open_input_file(f"{base}/{file}")
                    r = parse_record(handle.read_at(length, offset))
                    rows.append((r.page_id, r.url, r.size, r.digest, r.kind, r.refers_to, key))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "key"]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        finally:
            if handle is not None:
                handle.close()

    # Neighbouring ranges of a file are read by one task, in order; a file is dealt over tasks by stretches of 8 MB.
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // TASK_BYTES)
    near = captures.repartition(tasks, "file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")
    return near.mapInArrow(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, key string")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> tuple[str, DataFrame, DataFrame]:
    """Write archives and index of pages; returns the folder, the directory of the index, and the captures."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, min_bytes)
    return folder, write_index(captures, folder), captures


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from its record.

    The keys of all pages are looked up in the index, and the records that it names are read.
    """
    folder, directory, captures = archive(pages, None, min_bytes)
    n_bytes = directory.agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0]
    found = look_up(captures.select("key").distinct(), directory, folder)
    return read_back(found, folder, n_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
