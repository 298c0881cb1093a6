"""WARC records in ZIP-packaged archives: writing, and reading by byte range without extraction.

An archive is a ZIP file with stored members: `archive/data.warc.gz` (each record a gzip member of its own),
`indexes/index.cdxj` (one line a record: offset, length, digest) and `datapackage.json`. The reader parses the end record,
the ZIP64 end record where there is one and the central directory, finds where the stored members begin, reads the indexes
and plans ranges of at most `RANGE_BYTES`. Ranges are dealt over the cluster, so one large archive is read by many tasks.

Payload: the html in UTF-8, null as empty. Of equal payloads the smallest page_id is written as `response`, the others as
`revisit` records without a body. Payloads are compared by SHA-1 and length.

Scale: html is read twice (digests, then writing) and never shuffled while the table of repeated payloads is within the
broadcast bound; beyond it that join shuffles. Archive paths come from a written table, so a retried task leaves at
most a file that nobody reads.

Edge cases: very long payloads are written and digested whole, an archive holding one record at least; of equal payloads the smallest page_id is the response; a null page_id is written as `null` and read back as null, and never is a response while a row with an id has
the payload. Rows that repeat page_id and payload have the same type. An empty table gives no archive and an empty result.
Other columns than page_id, url and html are ignored; url may be absent or null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(uri: str):
    """File system and path of a URI of any scheme that Arrow knows; a bare path is local."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing -------------------------------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. `refers_to` is the page id of the response that a revisit repeats, None for a response."""
    name = lambda x: f"<urn:weft:page:{'null' if x is None else x}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:weft:page:{page_id}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class ArchiveWriter:
    """Gathers records and writes them as one ZIP-packaged archive."""

    def __init__(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        at = self.data.tell()
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.data.write(packed.compress(record_bytes(page_id, url, payload, refers_to)) + packed.flush())
        self.index.append(json.dumps({"offset": at, "length": self.data.tell() - at, "digest": digest32(payload)}))

    def write(self, uri: str) -> None:
        fs, path = opened(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), self.data.getbuffer())
            z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(f"page {x}\n" for x in self.index))
            z.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = ArchiveWriter(), []

        def close() -> None:
            nonlocal writer
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            writer.write(uri)
            done.append((uri, len(writer.index)))
            writer = ArchiveWriter()

        for batch in batches:
            for page, url, html, first in zip(*batch.columns, strict=True):
                writer.add(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), first.as_py())
                if writer.data.tell() >= archive_bytes:
                    close()
        if writer.index:
            close()
        if done:
            uris, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of `pages`; returns a written table of archive URIs and record counts."""
    spark = pages.sparkSession
    folder = folder or common.scratch_path(spark, "warc")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    pages = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # The WARC digest is SHA-1, of which collisions are known: what decides here is SHA-256 and the length
    key = [F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.octet_length("html").alias("bytes")]
    same = pages.select("page_id", *key).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = common.written(same, "warc-same")
    typed = pages.select("*", *key).join(common.bounded(same), ["sha", "bytes"], "left")
    rows = typed.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return common.written(common.mapped(rows, _write(folder, archive_bytes), "archive string, records long"), "warc-archives")


# --- reading -------------------------------------------------------------------------------------------------------


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset of a directory entry, those at the 32-bit limit taken from its ZIP64 field."""
    while len(extra) >= 4:
        kind, size = struct.unpack("<HH", extra[:4])
        if kind == 1:
            field = io.BytesIO(extra[4 : 4 + size])
            return [struct.unpack("<Q", field.read(8))[0] if v == 0xFFFFFFFF else v for v in values]
        extra = extra[4 + size :]
    return values


def directory(file, size: int) -> list[dict]:
    """Central directory of a ZIP file: name, method, packed and full size, header offset of each member."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[max(0, end - 20) : end]
    if locator[:4] == b"PK\x06\x07":
        at = struct.unpack("<Q", locator[8:16])[0]
        record = read(at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    data, members, at = read(start, length), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, full = struct.unpack("<II", data[at + 20 : at + 28])
        n, m, k = struct.unpack("<HHH", data[at + 28 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n].decode("utf-8", "replace")
        # ZIP64 holds full size, packed size, offset in this order, each only if needed
        full, packed, header = _wide(data[at + 46 + n : at + 46 + n + m], [full, packed, header])
        members.append({"name": name, "method": method, "packed": packed, "size": full, "header": header})
        at += 46 + n + m + k
    return members


def member_start(file, member: dict) -> int:
    """Offset of a member's first byte: past its local header, whose name and extra field have their own lengths."""
    file.seek(member["header"])
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member['name']}")
    n, m = struct.unpack("<HH", head[26:30])
    return member["header"] + 30 + n + m


def ranges(uri: str, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """Runs of adjacent records of an archive: the first byte and the records' lengths."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as file:
        members = directory(file, file.size())
        stored = {m["name"].removeprefix("archive/"): m for m in members if m["name"].startswith("archive/") and m["method"] == 0}
        indexes = [m for m in members if re.match(r"indexes/.*\.cdxj(\.gz)?$", m["name"])]
        if not stored or not indexes:
            raise ValueError(f"{uri}: a stored archive member and an index are needed")
        bases, places = {name: member_start(file, m) for name, m in stored.items()}, set()
        for index in indexes:
            file.seek(member_start(file, index))
            text = file.read(index["packed"])
            text = zlib.decompress(text, -15) if index["method"] == 8 else text
            text = gzip.decompress(text) if index["name"].endswith(".gz") else text
            for line in text.decode().splitlines():
                entry = json.loads(line[line.index("{") :])
                # An entry names its member; without a name there must be only one
                name = entry.get("filename", "").removeprefix("archive/") or (next(iter(bases)) if len(bases) == 1 else "")
                if name not in bases:
                    raise ValueError(f"{uri}: no stored archive member {name!r}, which the index names")
                places.add((bases[name] + int(entry["offset"]), int(entry["length"])))
    first, lengths, end = 0, [], -1
    for at, n in sorted(places):
        if lengths and (at != end or end + n - first > range_bytes):
            yield first, lengths
            lengths = []
        if not lengths:
            first = at
        lengths.append(n)
        end = at + n
    if lengths:
        yield first, lengths


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a WARC record and the payload after its HTTP header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _plan(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for at, lengths in ranges(uri, range_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([at], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], ["archive", "start", "lengths"])

    return run


def _page(name: str | None) -> int | None:
    value = re.fullmatch(r"<urn:weft:page:(-?\d+|null)>", name or "")
    return int(value[1]) if value and value[1] != "null" else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, lengths in zip(*batch.columns, strict=True):
                fs, path = opened(uri.as_py())
                lengths, rows = lengths.as_py(), []
                with fs.open_input_file(path) as file:
                    file.seek(start.as_py())
                    block = file.read(sum(lengths))
                at = 0
                for n in lengths:
                    headers, payload = parsed(zlib.decompress(block[at : at + n], 31))
                    at += n
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(payload) != digest:
                        raise ValueError(f"{uri}: payload of {headers['WARC-Record-ID']} does not have its digest")
                    size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    rows.append((_page(headers["WARC-Record-ID"]), size, digest, kind, _page(headers.get("WARC-Refers-To")), payload if kind == "response" else None))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays(arrays if with_payload else arrays[:5], names if with_payload else names[:5])

    return run


def read_archives(archives: DataFrame, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the archives in column `archive`; with `payload` (null for revisits) if wanted."""
    spark: SparkSession = archives.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    planned = archives.select("archive").repartition(width, F.col("archive")).mapInArrow(_plan(range_bytes), "archive string, start long, lengths array<long>")
    dealt = planned.repartition(width, F.col("archive"), F.col("start"))
    return dealt.mapInArrow(_read(with_payload), RECORD + (", payload binary" if with_payload else ""))
