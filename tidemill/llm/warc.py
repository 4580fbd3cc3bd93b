"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (each record gzipped by
itself) and ``indexes/index.cdxj`` (a line for each record with its offset and length in that member). The reader reads
the end of the file, the ZIP64 locator and record where there are any, and the central directory; it finds where a
member's bytes start from its local header, and reads the index and then each record by its byte range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, new_path, sieve, stored

#: Payloads shorter than this are always stored in full.
LEAST_SHARED = 100
#: Bytes of records after which a task starts another archive; bounds its memory.
ARCHIVE_BYTES = 24 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
CRLF = b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP header only, with the length of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + body + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), payload and the length of the full payload of one record."""
    head, _, rest = raw.partition(CRLF + CRLF)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(CRLF + CRLF)
    return headers, payload, int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])


class ZipRanges:
    """Members of a ZIP file and byte ranges of stored members, read by seeking; nothing is extracted."""

    def __init__(self, f) -> None:
        self.f = f
        self.size = f.seek(0, 2)
        self.members = self._directory()

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name: (offset of the local header, stored size, method)."""
        tail_at = max(0, self.size - 65_557)
        tail = self._read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        if 0xFFFF == count or 0xFFFFFFFF in (size, at):
            locator = self._read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            zip64 = self._read(struct.unpack("<Q", locator[8:16])[0], 56)
            if zip64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack("<QQQ", zip64[32:56])
        raw, p, members = self._read(at, size), 0, {}
        for _ in range(count):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, stored_size, full_size = struct.unpack("<H8xII", raw[p + 10 : p + 28])
            n_name, n_extra, n_comment = struct.unpack("<HHH", raw[p + 28 : p + 34])
            header = struct.unpack("<I", raw[p + 42 : p + 46])[0]
            name, extra = raw[p + 46 : p + 46 + n_name].decode(), raw[p + 46 + n_name : p + 46 + n_name + n_extra]
            while len(extra) >= 4:  # ZIP64 holds those of the three that are 0xFFFFFFFF, in this order
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    values = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    if full_size == 0xFFFFFFFF:
                        values.pop(0)
                    if stored_size == 0xFFFFFFFF:
                        stored_size = values.pop(0)
                    if header == 0xFFFFFFFF:
                        header = values.pop(0)
                extra = extra[4 + n :]
            members[name] = (header, stored_size, method)
            p += 46 + n_name + n_extra + n_comment
        return members

    def range(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member."""
        header, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        local = self._read(header, 30)
        n_name, n_extra = struct.unpack("<HH", local[26:30])
        return self._read(header + 30 + n_name + n_extra + offset, size - offset if length is None else min(length, size - offset))


def package(records: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """A ZIP archive of (page_id, url, raw record)."""
    data, lines = io.BytesIO(), []
    for page_id, url, raw in records:
        zipped = gzip.compress(raw, compresslevel=4, mtime=0)
        lines.append(f"{page_id} 20240101000000 " + json.dumps({"url": url, "offset": data.tell(), "length": len(zipped), "filename": DATA}))
        data.write(zipped)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipfile.ZipInfo(DATA), data.getbuffer())
        z.writestr(zipfile.ZipInfo(INDEX), "\n".join(lines).encode("utf-8", "surrogatepass"))
    return out.getvalue()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives below ``path`` (a folder that all executors share) and return a table of their paths, already
    written. A null payload is empty. Of records with equal payloads of LEAST_SHARED bytes or more, those with the
    smallest id are responses and the others are revisits; a null id is never the smallest. Every task names its
    files anew and only the files of tasks that ended well are in the table, so lost or repeated tasks do no harm."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = base.filter(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    shared = stored(shared, "shared-payloads")
    maybe, alone = sieve(base, "digest", shared)  # payloads that stand alone are not shuffled
    typed = hot_join(maybe, shared, "digest", "n").unionByName(alone.withColumn("first", F.lit(None).cast("long")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = typed.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[int | None, str | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            where, root = fs.FileSystem.from_uri(path)
            where.create_dir(root, recursive=True)
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            with where.open_output_stream(name) as f:
                f.write(package(kept))
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name.rsplit('/', 1)[1]}"]), pa.array([len(kept)], pa.int64())], ["path", "records"])

        for b in batches:
            for page_id, url, body, digest, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = record(page_id, url, body or b"", digest, n, first, first is not None)
                kept.append((page_id, url, raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return stored(rows.mapInArrow(work, "path string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (a table with ``path``): page_id, url, record_type, refers_to, payload_bytes and
    payload_digest (of the full payload), payload (null for a revisit). A response whose payload doesn't match its
    digest is an error."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    z, rows = ZipRanges(f), []
                    for line in z.range(INDEX).decode("utf-8", "surrogatepass").split("\n"):
                        entry = json.loads(line.split(" ", 2)[2])
                        headers, payload, size = parse(gzip.decompress(z.range(entry["filename"], entry["offset"], entry["length"])))
                        revisit, digest = headers["warc-type"] == "revisit", headers["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: payload of page {headers.get('x-page-id')} is damaged")
                        page, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((page and int(page), entry["url"], headers["warc-type"], first and int(first), size, digest, None if revisit else payload))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return archives.select("path").mapInArrow(work, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read them back, without the payloads."""
    archives = write(pages, new_path(pages.sparkSession, "warc"))
    n = max(1, min(archives.count(), 10_000))
    spread = archives.repartition(n, "path")  # one archive is enough work for a task
    return read(spread).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
t AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first END AS refers_to
FROM t
"""
