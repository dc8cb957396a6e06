"""WARC records in ZIP-packaged archives, and a reader that needs no extraction.

*Writing.* A task packs its pages into archives: ZIP files with stored (not
deflated) members ``archive/data.warc.gz``, one gzip member per record, and
``indexes/index.cdxj``, one line per record with its offset and length. A new
archive begins once one holds ``ROLL_BYTES``. Archives appear whole or not at all,
and carry fixed dates, so a repeated task writes the same bytes.

*Equal payloads.* Payload digests are grouped by a combined minimum. Of records
with equal payloads of at least ``min_bytes`` bytes those with the smallest page
id are responses, the others revisits that refer to it and leave the payload out.
The verdict is joined back by id and digest, keys that no hot payload makes hot.

*Reading.* The reader takes the end of a file, parses the end record, the ZIP64
locator and end record if there are any, and the central directory with its ZIP64
fields. It skips each stored member's local header to find where the data begin,
reads the index, and then ranges of records, neighbouring ones in one request.

A null html has an empty payload, a null url an empty target. Rows without an id
are revisits if another row with their payload has one, else responses. Payloads of any
length are whole. Other columns aren't read, so their names can't clash, and an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrid.session import stage_root

from .files import opened, written
from .shared import staged
from .texts import slices

MIN_BYTES = 0
ROLL_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5d2f6b0e-6f0c-4a54-9d2e-3f4a1c0b7e11")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-Number: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-Number: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def squeezed(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Record:
    """Headers and block of one record."""

    def __init__(self, data: bytes):
        raw = zlib.decompress(data, 31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        self.block = rest[: int(self.headers["content-length"])]
        http, _, self.payload = self.block.partition(b"\r\n\r\n")
        self.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}

    def number(self, name: str) -> int | None:
        value = self.headers.get(name)
        return None if value is None else int(value)


class Archive:
    """Members of a ZIP file by range reads."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.members = {m["name"]: m for m in self._directory()}

    def bytes(self, at: int, size: int) -> bytes:
        out = self.file.read_at(size, at) if size else b""
        if len(out) != size:
            raise ValueError("the archive ends early")
        return out

    def _directory(self) -> Iterator[dict]:
        # The end record is the last thing but for a comment of at most 65 535 bytes.
        reach = min(self.size, 22 + 65_535)
        tail = self.bytes(self.size - reach, reach)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            end = self.size - reach + at
            locator = self.bytes(end - 20, 20) if end >= 20 else b""
            if locator[:4] == b"PK\x06\x07":
                (record_at,) = struct.unpack_from("<Q", locator, 8)
                large = self.bytes(record_at, 56)
                if large[:4] != b"PK\x06\x06":
                    raise ValueError("broken ZIP64 end record")
                count, length, start = struct.unpack_from("<QQQ", large, 32)
        directory = self.bytes(start, length)
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, n, e, c = struct.unpack_from("<IIHHH", directory, at + 20)
            (local,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n : at + 46 + n + e]
            x = 0
            while x + 4 <= len(extra):
                kind, size = struct.unpack_from("<HH", extra, x)
                if kind == 1:  # the fields that did not fit, in this order
                    wide = x + 4
                    if plain == 0xFFFFFFFF:
                        (plain,), wide = struct.unpack_from("<Q", extra, wide), wide + 8
                    if packed == 0xFFFFFFFF:
                        (packed,), wide = struct.unpack_from("<Q", extra, wide), wide + 8
                    if local == 0xFFFFFFFF:
                        (local,) = struct.unpack_from("<Q", extra, wide)
                x += 4 + size
            yield {"name": name, "method": method, "size": plain, "packed": packed, "local": local, "flags": flags}
            at += 46 + n + e + c

    def start(self, name: str) -> int:
        """Where a stored member's data begin."""
        member = self.members[name]
        if member["method"] != 0 or member["flags"] & 1:
            raise ValueError(f"{name} is not stored plainly")
        if "start" not in member:
            local = self.bytes(member["local"], 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("broken local header")
            n, e = struct.unpack_from("<HH", local, 26)
            member["start"] = member["local"] + 30 + n + e
        return member["start"]

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        """A range of a stored member."""
        whole = self.members[name]["size"]
        size = whole - at if size is None else size
        if at < 0 or size < 0 or at + size > whole:
            raise ValueError("range outside the member")
        return self.bytes(self.start(name) + at, size)

    def index(self) -> list[dict]:
        """The index entries, by offset."""
        lines = self.read(INDEX).decode("utf-8").splitlines()
        return sorted((json.loads(x.split(" ", 2)[2]) for x in lines if x), key=lambda e: e["offset"])

    def records(self, entries: list[dict], most: int = RANGE_BYTES) -> Iterator[Record]:
        """Records of index entries in order of offset; neighbours share a range read."""
        k = 0
        while k < len(entries):
            first, to = entries[k]["offset"], k
            end = first
            while to < len(entries) and entries[to]["offset"] == end and (to == k or end + entries[to]["length"] - first <= most):
                end += entries[to]["length"]
                to += 1
            data = self.read(DATA, first, end - first)
            for e in entries[k:to]:
                yield Record(data[e["offset"] - first : e["offset"] - first + e["length"]])
            k = to


def _sort_key(url: str) -> str:
    """Host parts reversed, then the path, as index lines are sorted."""
    host, slash, path = url.partition("://")[2].partition("/") if "://" in url else (url, "", "")
    return (",".join(reversed(host.lower().split("."))) + ")" + slash + path).replace(" ", "%20") or ")"


class Packer:
    """Writes archives of about ``roll`` bytes one after the other."""

    def __init__(self, folder: str, part: int, roll: int):
        self.folder, self.part, self.roll = folder, part, roll
        self.made: list[tuple[str, int]] = []
        self.zip = None

    def _open(self) -> None:
        self.uri = f"{self.folder}/pages-{self.part:06d}-{len(self.made):04d}.wacz"
        self.whole = written(self.uri)
        self.out = self.whole.__enter__()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> None:
        if self.zip is None:
            self._open()
        data = squeezed(record(page_id, url, payload, digest, refers_to, revisit))
        self.member.write(data)
        entry = {"url": url, "digest": f"sha1:{digest}", "mime": "warc/revisit" if revisit else "text/html", "status": "200",
                 "filename": DATA.split("/")[1], "offset": self.at, "length": len(data), "page": page_id}
        self.lines.append(f"{_sort_key(_line(url))} {DATE.translate(str.maketrans('', '', '-:TZ'))} {json.dumps(entry)}")
        self.at += len(data)
        if self.at >= self.roll:
            self.close()

    def close(self) -> None:
        if self.zip is None:
            return
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)) + "\n")
        self.zip.close()
        self.whole.__exit__(None, None, None)
        self.made.append((self.uri, len(self.lines)))
        self.zip = None


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES,
          roll: int = ROLL_BYTES) -> DataFrame:
    """Write all pages; returns (uri, records) of each archive as a local table."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keys = staged(rows.select("page_id", "digest", F.octet_length("html").alias("size")), "warc-digests")
    first = keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    again = (
        keys.join(first.where("n > 1 and refers_to is not null"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct()
    )
    judged = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select(
        "page_id", "url", "html", "digest", "refers_to"
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(folder, TaskContext.get().partitionId(), roll)
        for batch in batches:
            for part, texts in slices(batch, "html"):
                columns = [part.column(k).to_pylist() for k in (0, 1, 3, 4)]
                for k, (page, target, digest, refers_to) in enumerate(zip(*columns, strict=True)):
                    bare = base64.b32encode(bytes.fromhex(digest)).decode()
                    packer.add(page, target, texts.text(k), bare, refers_to, refers_to is not None)
        packer.close()
        if packer.made:
            yield pa.RecordBatch.from_pydict({"uri": [u for u, _ in packer.made], "records": [n for _, n in packer.made]})

    schema = "uri string, records long"
    # One short row per archive comes to the driver.
    return spark.createDataFrame(sorted(judged.mapInArrow(apply, schema).collect()), schema)


def read(archives: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                archive = Archive(uri)
                entries = archive.index()
                for at in range(0, len(entries), 2000):
                    out = []
                    for r in archive.records(entries[at : at + 2000]):
                        kind = r.headers["warc-type"]
                        digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
                        size = int(r.http["content-length"])
                        if kind == "response":
                            if len(r.payload) != size or base64.b32encode(hashlib.sha1(r.payload).digest()).decode() != digest:
                                raise ValueError(f"damaged record in {uri}")
                        out.append((r.number("warc-page-number"), size, digest, kind, r.number("warc-refers-to-page-number"),
                                    r.headers.get("warc-target-uri")))
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    count = archives.count()
    listed = archives.select("uri")
    return (listed.repartitionByRange(count, "uri") if count else listed).mapInArrow(apply, schema)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages under the shared folder and read the archives back."""
    folder = f"{stage_root(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, id, url, html, min_bytes))
