"""WARC records in ZIP archives: writer and range reader.

An archive is a ZIP file with stored members: `archive/data.warc.gz` (one gzip
member per record), `indexes/index.cdxj` (a sorted key, then JSON with offset
and length of each record in the data member) and `datapackage.json`. The
reader parses the end record, the ZIP64 end record and the central directory with
range reads, finds stored archive and index members, and reads records by
range; nothing is extracted and no member is read as a whole but its index.

Payloads of MIN_REVISIT bytes or more that occur more than once are written once:
the record with the largest page_id is the response, the others are revisits (RFC-style
`identical-payload-digest`) that refer to it and keep its HTTP header, digest and length.

Archives are closed at ARCHIVE_BYTES, so a task holds one archive at a time. A
manifest names the archives that count; files of failed attempts are never read.

Defined results: null html is an empty payload; null url is left out of the record; a null
page_id is written without one and refers to others as usual, but is never referred to; rows with
the same page_id as the response are responses too; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import binascii
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.llm import storage

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
SPLIT_RECORDS = 2000
GZIP_LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORD_ID = "urn:talkweave:page:"
#: Fixed values of the ZIP format: signatures and layouts.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
CENTRAL_LAYOUT, LOCAL_SIZE, END_SIZE, LOCATOR_SIZE = "<4s6H3L5H2L", 30, 22, 20
MANIFEST = "uri string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record with its HTTP message."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of RECORDS from the bytes of one record; a response's digest is checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip(" \t").lower(): v.strip(" \t") for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda s: int(m[1]) if (m := re.search(r":(-?\d+)>$", s or "")) else None
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


class ArchiveWriter:
    """Collects records of one archive in memory, up to ARCHIVE_BYTES."""

    def __init__(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> None:
        raw = gzip.compress(record(page_id, url, payload, refers_to, revisit), GZIP_LEVEL, mtime=0)
        at = self.data.tell()
        self.data.write(raw)
        self.index.append((url or "", {"page_id": page_id, "filename": "data.warc.gz", "offset": at, "length": len(raw)}))

    def finished(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), self.data.getvalue())
            lines = [f"{re.sub(r'\s', '%20', url) or '-'} {json.dumps(at)}\n" for url, at in sorted(self.index, key=lambda x: (x[0], x[1]["offset"]))]
            z.writestr(zipfile.ZipInfo("indexes/index.cdxj"), "".join(lines))
            z.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz", "records": len(self.index)}]}))
        return out.getvalue()


class ZipArchive:
    """A ZIP file that is only read by ranges. `file` has seek, read and size()."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - END_SIZE - LOCATOR_SIZE - (1 << 16))
        tail = self.range(tail_at, self.size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no ZIP end record")
        entries, size, at = struct.unpack_from("<HLL", tail, end + 10)
        if tail[max(0, end - LOCATOR_SIZE) : end][:4] == LOCATOR64:
            (place,) = struct.unpack_from("<Q", tail, end - LOCATOR_SIZE + 8)
            end64 = self.range(place, 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record where its locator points")
            entries, size, at = struct.unpack_from("<QQQ", end64, 32)
        self.members = self._directory(self.range(at, size), entries)

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    @staticmethod
    def _directory(raw: bytes, entries: int) -> dict[str, dict]:
        found, at = {}, 0
        for _ in range(entries):
            sig, _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, place = struct.unpack_from(CENTRAL_LAYOUT, raw, at)
            if sig != CENTRAL:
                raise ValueError("damaged central directory")
            at += struct.calcsize(CENTRAL_LAYOUT)
            name = raw[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: those of the three that overflow, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    place = next(wide) if place == 0xFFFFFFFF else place
                extra = extra[4 + n :]
            found[name] = {"method": method, "crc": crc, "packed": packed, "size": size, "place": place}
        return found

    def data_at(self, name: str) -> int:
        """Where a member's bytes begin: behind its local header."""
        m = self.members[name]
        if "data" not in m:
            head = self.range(m["place"], LOCAL_SIZE)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            m["data"] = m["place"] + LOCAL_SIZE + n_name + n_extra
        return m["data"]

    def member_range(self, name: str, at: int, n: int) -> bytes:
        m = self.members[name]
        if m["method"]:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        return self.range(self.data_at(name) + at, min(n, m["size"] - at))

    def whole(self, name: str) -> bytes:
        m = self.members[name]
        raw = self.range(self.data_at(name), m["packed"])
        raw = zlib.decompress(raw, -15) if m["method"] == 8 else raw
        if binascii.crc32(raw) != m["crc"]:
            raise ValueError(f"{name} is damaged")
        return raw

    def records(self) -> list[tuple[str, int, int]]:
        """(member, offset, length) of every record that the indexes name, in the order of the data."""
        data = sorted(n for n, m in self.members.items() if re.fullmatch(r"archive/.*\.warc(\.gz)?", n) and not m["method"])
        out = []
        for name in sorted(n for n in self.members if re.fullmatch(r"indexes/.*\.cdxj?", n)):
            for line in self.whole(name).decode().splitlines():
                at = json.loads(line[line.index("{") :])
                if not at.get("filename") and len(data) != 1:
                    raise ValueError("an index line without a file name, and more or less than one data member")
                member = f"archive/{at['filename']}" if at.get("filename") else data[0]
                out.append((member, int(at["offset"]), int(at["length"])))
        return sorted(out)

    def read(self, member: str, at: int, n: int) -> dict:
        raw = self.member_range(member, at, n)
        return parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


def planned(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses)."""
    storage.bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_revisit, F.unhex(F.sha1("payload"))))
    copies = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    copies = copies.select(F.col("digest").alias("of"), "response")
    # only rows with copies move: a digest that occurs once stays where it is
    shared = storage.staged(rows.select("page_id", "digest").where("digest is not null").join(copies, F.col("digest") == F.col("of")).where("page_id is null or page_id <> response").select("page_id", "digest", "response").distinct(), "warc-revisits")
    found = shared.select(F.col("page_id").alias("revisit_page"), F.col("digest").alias("revisit_digest"), F.col("response").alias("refers_to"))
    return rows.join(found, rows["page_id"].eqNullSafe(found["revisit_page"]) & (rows["digest"] == found["revisit_digest"]), "left").select("page_id", "url", "payload", "refers_to")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records; the manifest of archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(w: ArchiveWriter) -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            size = storage.write_file(uri, [w.finished()])
            return pa.record_batch([pa.array([uri]), pa.array([len(w.index)], pa.int64()), pa.array([size], pa.int64())], names=["uri", "records", "bytes"])

        writer = ArchiveWriter()
        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                writer.add(page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py(), refers.is_valid)
                if writer.data.tell() >= archive_bytes:
                    yield close(writer)
                    writer = ArchiveWriter()
        if writer.index:
            yield close(writer)

    return storage.staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, split: int = SPLIT_RECORDS) -> DataFrame:
    """RECORDS of all archives of a manifest (uri, records). Each index is read once; the ranges that it names are read by several tasks, batches bounded by bytes."""
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    place = pa.struct([("member", pa.string()), ("at", pa.int64()), ("n", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                found = [dict(zip(("member", "at", "n"), r, strict=True)) for r in ZipArchive(storage.open_file(uri)).records()]
                parts = [found[k : k + split] for k in range(0, len(found), split)]
                yield pa.record_batch([pa.array([uri] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.list_(place))], names=["uri", "part", "places"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in types.items()], names=list(types))

        for batch in batches:
            for uri, places in zip(batch.column("uri").to_pylist(), batch.column("places").to_pylist(), strict=True):
                archive = ZipArchive(storage.open_file(uri))
                rows, size = [], 0
                for p in places:
                    rows.append(archive.read(p["member"], p["at"], p["n"]))
                    size += len(rows[-1]["payload"] or b"")
                    if size >= storage.BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    splits = manifest.select("uri").repartition("uri").mapInArrow(index, "uri string, part long, places array<struct<member: string, at: long, n: long>>")
    return splits.repartition("uri", "part").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per page and read the archives back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(planned(pages), folder or storage.new_folder(spark, "warc")))
