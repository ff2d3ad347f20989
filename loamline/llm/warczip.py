"""WARC records in ZIP-packaged archives, written by tasks and read back by ranges.

A package is a ZIP file whose two members are stored, not compressed: ``records.warc.gz``, one gzip member for each
record, and ``index.cdx``, a line with offset and length for each. A reader fetches the end of the file, the central
directory (ZIP64 where sizes need it), the index, and then the ranges of records that it wants; nothing is extracted.
Packages go to the shared folder through pyarrow's file systems. A task writes a package under a name of its own attempt
and only then reports it, so the packages of lost attempts are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, new_path, written

PACKAGE, LEVEL, READ = 32 << 20, 1, 1 << 20
#: Tasks that read packages, at most; beyond that one reads several.
TASKS = 10_000
RECORDS, INDEX = "records.warc.gz", "index.cdx"
DATE = "2024-01-01T00:00:00Z"


# --- ZIP layout (fixed values of the format) ---
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL = 0xFFFFFFFF


class ZipWriter:
    """Stored members to a stream that only goes forward. Sizes are known before a member is written; ZIP64 fields are
    used where they or an offset do not fit, or always with zip64=True."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.entries = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, parts: list[bytes]) -> None:
        size, crc, raw = sum(map(len, parts)), 0, name.encode()
        for p in parts:
            crc = zlib.crc32(p, crc)
        big = self.zip64 or size >= _FULL or self.at >= _FULL
        self.entries.append((raw, crc, size, self.at, big))
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = _FULL if big else size
        self._put(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if big else 20, 0, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        for p in parts:
            self._put(p)

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at, big in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            shown, where = (_FULL, _FULL) if big else (size, at)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if big else 20, 0, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra)
        n, size, end = len(self.entries), self.at - start, self.at
        big = self.zip64 or start >= _FULL or any(e[4] for e in self.entries)
        if big:
            self._put(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", _LOCATOR, 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, _FULL if big else start, 0))


def members(f) -> dict[str, tuple[int, int]]:
    """Place and size of the stored members of the ZIP in a seekable file, from its central directory."""
    total = f.size()
    tail_at = max(0, total - 65_557)
    f.seek(tail_at)
    tail = f.read(total - tail_at)
    e = tail.rfind(_END)
    if e < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, size, start, _ = struct.unpack_from("<4sHHHHIIH", tail, e)
    if e >= 20 and tail[e - 20 : e - 16] == _LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, e - 12)
        f.seek(end64)
        n, size, start = struct.unpack_from("<QQQ", f.read(56), 32)
    f.seek(start)
    directory, at, found = f.read(size), 0, {}
    for _ in range(n):
        head = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
        if head[0] != _CENTRAL:
            raise ValueError("bad central directory")
        method, packed, size, n_name, n_extra, n_note, where = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, i = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, length = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # the 64-bit values of the fields that are full, in this order
                j = i + 4
                if size == _FULL:
                    (size,), j = struct.unpack_from("<Q", extra, j), j + 8
                if packed == _FULL:
                    (packed,), j = struct.unpack_from("<Q", extra, j), j + 8
                if where == _FULL:
                    (where,) = struct.unpack_from("<Q", extra, j)
            i += 4 + length
        at += 46 + n_name + n_extra + n_note
        if method:
            raise ValueError(f"{name} is compressed")
        f.seek(where)
        n_name, n_extra = struct.unpack_from("<HH", f.read(30), 26)
        found[name] = (where + 30 + n_name + n_extra, size)
    return found


# --- records ---
def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit without, as a gzip member. Both name the full payload's digest and size."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head = "\r\n".join([*lines, f"Content-Length: {len(payload)}", "", ""]).encode()
    return gzip.compress(head + payload + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def classes(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """For each payload of at least `least` bytes that has several rows: its two digests, size and response (the largest id)."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("key"), F.length(body).alias("size")).where(F.col("size") >= least)
    return p.groupBy("key").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes one record per row of pages and returns the packages (path, records, bytes).

    Of rows with equal payloads of at least `least` bytes, that with the largest id is the response and the others
    revisit it; smaller payloads are all responses. Payloads are text in UTF-8, null ones empty. Rows repeated with the
    largest id are responses each; a row with a null id revisits like any other, and where all ids are null all are
    responses. Line breaks in a URL are percent-encoded, null URLs left out."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("key"), F.col(id_col).alias("raw"))
    rows = rows.join(classes(pages, id_col, payload_col, least), "key", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("raw").eqNullSafe(F.col("response")), F.col("response").cast("string"))
    rows = rows.select("id", "url", "body", refers.alias("refers"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lines, at = [], [], 0

        def package() -> pa.RecordBatch:
            nonlocal parts, lines, at
            system, folder = _file_system(path)
            system.create_dir(folder, recursive=True)
            name = f"{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{folder}/{name}") as out:
                z = ZipWriter(out)
                z.member(RECORDS, parts)
                z.member(INDEX, ["".join(lines).encode()])
                z.close()
                row = (f"{path}/{name}", len(lines), z.at)
            parts, lines, at = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in stream:
            for id_, url, body, refers in zip(*(c for c in batch.columns)):
                payload = body.as_py()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = record(id_.as_py(), url.as_py(), payload, digest, refers.as_py())
                lines.append(f"{at} {len(data)} {digest}\n")
                parts.append(data)
                at += len(data)
                if at >= PACKAGE:
                    yield package()
        if parts:
            yield package()

    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "packages")


def scan(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of packages (path): page_id string, url, payload_bytes, payload_digest, record_type, refers_to
    string and, with payloads, the payload (null for revisits), each fetched by its range."""
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    arrow = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())] + [("payload", pa.binary())] * payloads)
    ident = lambda x: x[len("<urn:page:") : -1] or None

    def records(path: str) -> Iterator[tuple]:
        system, name = _file_system(path)
        with system.open_input_file(name) as f:
            at = members(f)
            f.seek(at[INDEX][0])
            spans = [tuple(map(int, line.split()[:2])) for line in f.read(at[INDEX][1]).decode().splitlines()]
            i = 0
            while i < len(spans):
                j = i + 1  # neighbours share a read
                while j < len(spans) and spans[j][0] + spans[j][1] - spans[i][0] <= READ:
                    j += 1
                low = spans[i][0]
                f.seek(at[RECORDS][0] + low)
                data = f.read(spans[j - 1][0] + spans[j - 1][1] - low)
                for start, size in spans[i:j]:
                    head, payload = parsed(data[start - low : start - low + size])
                    kind = head["WARC-Type"]
                    row = (ident(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, ident(head["WARC-Refers-To"]) if kind == "revisit" else None)
                    yield row + ((payload if kind == "response" else None),) * payloads
                i = j

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (x.as_py() for b in stream for x in b.column(0))
        return batches((r for p in paths for r in records(p)), arrow, 256 if payloads else 2048)

    n = packages.count()  # a partition count of our own, which adaptive execution does not merge
    return packages.select("path").repartition(max(1, min(n, TASKS)), "path").mapInArrow(run, schema)


def archived(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """`write` to a new folder in the shared one, then `scan`, with the ids in their own type."""
    packages = write(pages, new_path(spark, "warc"), id_col=id_col, **options)
    kind = pages.schema[id_col].dataType
    found = scan(packages)
    return found.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


#: DuckDB SQL for the records of pages; base32 takes 5 hex digits to 4 letters.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(p.h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN p.page_id = r.response OR r.response IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = r.response THEN NULL ELSE r.response END AS refers_to
FROM p JOIN r ON p.h = r.h
"""
