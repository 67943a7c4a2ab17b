"""WARC records in ZIP-packaged archives, read by ranges without extraction.

Writing. Each task packs its pages into ZIP archives of about
``ARCHIVE_BYTES``: a stored member ``archive/data.warc.gz`` (one gzip member a
record) and a stored index member ``indexes/index.cdxj`` (a line a record:
page, offset, length). Of equal payloads of at least ``revisit_bytes`` bytes
the one with the largest page_id is a response, the others are revisits. The
files' names are unique to a task attempt and enter the manifest, a Parquet
table, only if the attempt is committed, so a lost executor leaves no half
archive behind that anyone reads.

Reading. The manifest's rows are ranges of records. A task reads the end of
the archive, its central directory (ZIP64 records included), the index member
and then only the bytes of its records.

Defined cases: null html is an empty payload; a null page_id makes an ordinary
record and is never referred to; rows that share page_id and payload are equals
(both response or both revisit); an empty table gives an empty result. Only page_id, url and html are read, so
other columns may have any name. A very long page is one record, which its task holds whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder

ARCHIVE_BYTES = 32 << 20
RANGE_RECORDS = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(head).encode() + http + payload + b"\r\n\r\n"


class Archive:
    """One archive under construction."""

    def __init__(self):
        self.buffer = io.BytesIO()
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, page_id, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        self.data.write(packed)
        self.index.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> bytes:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        return self.buffer.getvalue()


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) -> written archives in folder; the manifest (path, first, records)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    latest = rows.where(F.col("n") >= revisit_bytes).groupBy(F.col("digest").alias("l_digest")).agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = rows.join(latest, (F.col("digest") == F.col("l_digest")) & (F.col("n") >= revisit_bytes), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))

    def run(batches):
        archive = None
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def finish():
            path = f"{root}/{uuid.uuid4().hex}.zip"
            with store.open_output_stream(path) as out:
                out.write(archive.close())
            first = list(range(0, len(archive.index), RANGE_RECORDS))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"] * len(first)), pa.array(first, pa.int64()), pa.array([min(RANGE_RECORDS, len(archive.index) - x) for x in first], pa.int64())], ["path", "first", "records"])

        for batch in batches:
            for page_id, url, body, digest, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                archive = archive or Archive()
                archive.add(page_id, _record(page_id, url, body, digest, to))
                if archive.at >= ARCHIVE_BYTES:
                    yield finish()
                    archive = None
        if archive:
            yield finish()

    manifest = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(run, "path string, first long, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, first long, records long").parquet(f"{folder}/manifest")


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


def directory(read, size: int) -> dict[str, Member]:
    """Members of a ZIP file by name; read(offset, length) -> bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail[end - 20 : end]
    if locator[:4] == b"PK\x06\x07":
        at = struct.unpack("<Q", locator[8:16])[0]
        wide = read(at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    data, at, out = read(start, length), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        header = struct.unpack("<I", data[at + 42 : at + 46])[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: the values that didn't fit, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out[name] = Member(name, method, packed, whole, header)
        at += 46 + n_name + n_extra + n_note
    return out


def stored_at(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.header + 30 + n_name + n_extra


def _page(value: str | None):
    text = (value or "").strip("<>").rpartition(":")[2]
    return None if text in ("", "none") else int(text)


def parse_record(data: bytes) -> dict:
    """Fields of one WARC record of an HTTP response or revisit; the payload is None for a revisit."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex() if revisit else hashlib.sha1(payload).hexdigest()
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload_bytes": n if revisit else len(payload), "payload_digest": digest, "payload": None if revisit else payload,
    }


READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of a manifest's ranges (see READ; without payloads that column is null)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, first, records in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "records")), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    read = lambda at, n: file.read_at(n, at)  # noqa: E731, B023
                    members = directory(read, file.size())
                    index, data = members[INDEX], members[DATA]
                    lines = read(stored_at(read, index), index.size).decode().split("\n")[first : first + records]
                    base = stored_at(read, data)
                    out = []
                    for line in lines:
                        entry = json.loads(line)
                        row = parse_record(zlib.decompress(read(base + entry["offset"], entry["length"]), 31))
                        if not payloads:
                            row["payload"] = None
                        out.append(row)
                        if len(out) == 200:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    yield pa.RecordBatch.from_pylist(out, schema)

    # a range is a few thousand KB: as many tasks as there are ranges, up to what the session shuffles with
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts).mapInArrow(run, READ)


def round_trip(pages: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Writes pages to a new folder of the shared place and reads the records back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), payloads=False).drop("payload")
