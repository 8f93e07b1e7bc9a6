"""WARC records in ZIP archives, and a reader that never extracts them.

An archive is a ZIP file with two stored members: gzip-compressed WARC records
one after the other, and an index line for each record. The reader parses the
end-of-central-directory records (ZIP64 too) and the central directory from the
file's tail, finds where the members' bytes start, reads the index by range, and
then reads ranges of records. Files go through pyarrow's file systems, so the
folder may be on any of them.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, shared_dir, staged

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Payloads of fewer bytes are always responses.
SHORT = 100
#: Compressed bytes of an archive, and of a range read at once, about.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 2 << 20


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its full payload's size and digest are header fields."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (where its bytes start, how many) of stored members. read(at, n) gives bytes of the file."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2L", tail[at + 10 : at + 20])
    locator = tail[at - 20 : at] if at >= 20 else b""
    if locator[:4] == b"PK\6\7":
        end = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<3Q", end[32:56])
    directory, p, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, full, n, extra, comment = struct.unpack("<2L3H", directory[p + 20 : p + 34])
        local = struct.unpack("<L", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n].decode()
        more, q = directory[p + 46 + n : p + 46 + n + extra], 0
        while q + 4 <= len(more):
            kind, room = struct.unpack("<2H", more[q : q + 4])
            if kind == 1:  # ZIP64: only the fields that didn't fit, in this order
                values = iter(struct.unpack(f"<{room // 8}Q", more[q + 4 : q + 4 + room // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            q += 4 + room
        if method == 0:
            n_local, extra_local = struct.unpack("<2H", read(local, 30)[26:30])
            found[name] = (local + 30 + n_local + extra_local, packed)
        p += 46 + n + extra + comment
    return found


def _file(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where, path


class Archive:
    """An archive in the making, in memory: about ARCHIVE_BYTES of compressed records."""

    def __init__(self):
        self.records, self.index, self.size = [], [], 0

    def add(self, raw: bytes, page_id: int | None) -> None:
        squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
        z = squeeze.compress(raw) + squeeze.flush()
        self.index.append(f"{'-' if page_id is None else page_id} {self.size} {len(z)}\n")
        self.records.append(z)
        self.size += len(z)

    def save(self, folder: str, name: str) -> str:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for member, raw in ((RECORDS, b"".join(self.records)), (INDEX, "".join(self.index).encode())):
                z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), raw)
        where, path = _file(folder)
        where.create_dir(path, recursive=True)
        hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
        with where.open_output_stream(hidden) as f:
            f.write(out.getbuffer())
        where.move(hidden, f"{path}/{name}")  # a task that runs twice leaves one whole file
        return f"{folder}/{name}"


def write_archives(pages: DataFrame, folder: str, each: int = 64 << 20) -> DataFrame:
    """Writes a record per row of page_id, url, html; returns the staged list of archives.

    Of equal payloads of at least SHORT bytes the smallest page_id's is the
    response, all others refer to it. Groups of equal payloads are found on
    digests alone, summed before they are shuffled; pages then meet the short list
    of their revisits by page_id and digest, so no group of copies is one task's.
    Null html is an empty payload, a null page_id a record without number, which no
    other refers to; repeated rows are a record each; an empty table has no archives.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.filter(F.octet_length("payload") >= SHORT).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    revisits = narrow.distinct().join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    key = [F.coalesce("page_id", F.lit(-(1 << 63))).alias("_key"), "digest"]
    dealt = rows.withColumn("_key", key[0]).join(revisits.select(*key, "first"), ["_key", "digest"], "left").repartition(partitions_for(pages, each), "_key", "digest")

    def write(it):
        part, k, made = TaskContext.get().partitionId(), 0, Archive()
        schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])

        def close():
            return pa.RecordBatch.from_arrays([pa.array([made.save(folder, f"part-{part:06d}-{k:04d}.zip")]), pa.array([len(made.index)], pa.int64())], schema=schema)

        for b in it:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made.add(record(page, url, payload, digest, refers, refers is not None), page)
                if made.size >= ARCHIVE_BYTES:
                    yield close()
                    made, k = Archive(), k + 1
        if made.index:
            yield close()

    return staged(dealt.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, "archive string, n_records long"))


def _reader(uri: str):
    where, path = _file(uri)
    f = where.open_input_file(path)
    return f, lambda at, n: bytes(f.read_at(n, at))


def record_ranges(archives: DataFrame) -> DataFrame:
    """archive, start, sizes: ranges of whole records, from the archives' directories and indexes."""
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("sizes", pa.list_(pa.int64()))])

    def ranges(it):
        for b in it:
            for uri in b.column(0).to_pylist():
                f, read = _reader(uri)
                with f:
                    found = members(read, f.size())
                    base, _ = found[RECORDS]
                    lines = read(*found[INDEX]).decode().splitlines()
                rows, start, sizes = [], base, []
                for line in lines:
                    _, at, n = line.split(" ")
                    if sizes and sum(sizes) + int(n) > RANGE_BYTES:
                        rows.append((uri, start, sizes))
                        start, sizes = base + int(at), []
                    sizes.append(int(n))
                if sizes:
                    rows.append((uri, start, sizes))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("archive").mapInArrow(ranges, "archive string, start long, sizes array<long>")


def read_records(ranges: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and payload if asked (null for revisits).

    A response's size and digest are those of the payload read, and its digest must be the one in its header.
    Records without number give a null page_id, empty payloads size 0; repeated ranges give their record each; no ranges, no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(urn: str) -> int | None:
        x = urn.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def read_all(it):
        for b in it:
            for uri, start, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f, read = _reader(uri)
                with f:
                    raw = read(start, sum(sizes))
                out, at = [], 0
                for n in sizes:
                    fields, http, payload = parse_record(zlib.decompress(raw[at : at + n], 31))
                    at += n
                    named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if fields["WARC-Type"] == "revisit":
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        out.append((number(fields["WARC-Record-ID"]), size, named, "revisit", number(fields["WARC-Refers-To"]), None))
                        continue
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest != named:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                    out.append((number(fields["WARC-Record-ID"]), len(payload), digest, "response", None, payload if payloads else None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    wide = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    out = ranges.select("archive", "start", "sizes").mapInArrow(read_all, wide)
    return out if payloads else out.drop("payload")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads every record back.

    One row per input row. Null html is an empty payload, null url an empty URI; a
    null page_id is never another record's response, and equal rows with the
    smallest page_id are both responses. An empty table gives no archives and an
    empty result.
    """
    spark: SparkSession = pages.sparkSession
    archives = write_archives(pages, shared_dir(spark))
    ranges = record_ranges(archives)
    return read_records(ranges.repartition(partitions_for(pages, 16 << 20)))
