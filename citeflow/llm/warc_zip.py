"""Web archives packed in ZIP files: written by tasks, read back by ranges without unpacking.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz``, one gzip member a WARC record, and
``indexes/index.cdxj``, one line a record with its place. As the members are stored, a record's place in the ZIP file
is known from the central directory and the index, and any record can be read by its range.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.tables import Scratch
from citeflow.session import scratch_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT_FROM = 1000  # bytes a payload has at least for its copies to be stored as revisits
ARCHIVE_BYTES = 256 << 20  # payload bytes after which a task begins another archive
RANGE_BYTES = 4 << 20  # neighbouring records read at once
RANGES_PER_TASK = 4
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the two formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_RECORD, LOCATOR64, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# ---- WARC records ---------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def _head(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with one record: a response with its payload, or a revisit of another one, which keeps the
    header of the answer (and so the payload's length) and the payload's digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        # A line break would end the field.
        fields.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = _head("WARC/1.1", [*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"
    return pack.compress(whole) + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(whole: bytes) -> dict:
    """One record, unpacked."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    answer, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    url = fields.get("warc-target-uri")
    refers_to = fields.get("warc-refers-to")
    if fields["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        size = len(payload)
    else:
        size, payload = int(_fields(answer)["content-length"]), None
    return {
        "page_id": _id(fields["warc-record-id"]),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["warc-type"], "refers_to": _id(refers_to) if refers_to else None,
        "payload": payload, "payload_bytes": size, "payload_digest": digest,
    }


def members_of(data: bytes) -> Iterator[bytes]:
    """The gzip members of a range, unpacked one by one."""
    while data:
        unpack = zlib.decompressobj(31)
        whole = unpack.decompress(data) + unpack.flush()
        if not unpack.eof:
            raise ValueError("a record is cut off")
        yield whole
        data = unpack.unused_data


# ---- ZIP directories ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def _range(file: pa.NativeFile, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) < length:
        raise ValueError("the archive is cut off")
    return data


def directory(file: pa.NativeFile, size: int) -> list[Member]:
    """Members by the central directory: the end record, for large archives its ZIP64 form, then the entries."""
    tail_at = max(0, size - (22 + FULL16))
    tail = _range(file, tail_at, size - tail_at)
    at = len(tail)
    while True:
        # The comment may hold the mark too: the right one's comment reaches the end of the file.
        at = tail.rfind(END_RECORD, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, offset):
        locator = _range(file, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end = _range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    entries, found, at = _range(file, offset, length), [], 0
    for _ in range(count):
        if entries[at : at + 4] != ENTRY:
            raise ValueError("a directory entry is broken")
        method, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<H8xII3H", entries, at + 10)
        header = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        packed, header = _sizes64(extra, plain, packed, header)
        found.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return found


def _sizes64(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
    """Packed size and place of the local header; the ZIP64 field holds, in this order, those that are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            if plain == FULL32:
                values.pop(0)
            if packed == FULL32:
                packed = values.pop(0)
            if header == FULL32:
                header = values.pop(0)
        at += 4 + length
    return packed, header


def place(file: pa.NativeFile, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    local = _range(file, member.header, 30)
    if local[:4] != LOCAL:
        raise ValueError("a local header is broken")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


# ---- archives -------------------------------------------------------------------------------------


class Archive:
    """One ZIP file being written, front to back, to any file system."""

    def __init__(self, stream, name: str):
        self.name, self.bytes, self.at, self.lines = name, 0, 0, []
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, page_id, url, payload: bytes, refers_to) -> None:
        packed = record(page_id, url, payload, refers_to)
        self.member.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        self.bytes += len(payload)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``: of pages with equal payloads of `REVISIT_FROM` bytes or more, those
    below the greatest page_id refer to it. A group of copies of any size is one row of an aggregation."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("_len", F.length("payload")).withColumn("_sha", F.sha1("payload"))
    rows = rows.withColumn("_key", F.when(F.col("_len") >= REVISIT_FROM, F.concat_ws("-", "_sha", "_len")))
    tops = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.max("page_id").alias("top"), F.count("*").alias("c"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return rows.join(tops.where("c > 1").select("_key", "top"), "_key", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Pack ``pages(page_id, url, html)`` into archives under ``folder``, a folder all executors share; returns the lazy
    manifest ``(archive, records)``. Write the manifest: an attempt gives its archives names of its
    own, and those of attempts that were lost or repeated are never listed."""
    rows = with_references(pages)

    def per_part(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        done, open_now, stream = [], None, None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if open_now is None:
                    files.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = files.open_output_stream(f"{base}/{name}")
                    open_now = Archive(stream, name)
                open_now.add(page_id, url, payload, refers_to)
                if open_now.bytes >= ARCHIVE_BYTES:
                    done.append(_closed(open_now, stream))
                    open_now = None
        if open_now is not None:
            done.append(_closed(open_now, stream))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["archive", "records"]
        )

    return rows.mapInArrow(per_part, "archive string, records long")


def _closed(archive: Archive, stream) -> tuple[str, int]:
    archive.close()
    stream.close()
    return archive.name, len(archive.lines)


def record_ranges(manifest: DataFrame, folder: str) -> DataFrame:
    """``(archive, start, length)``: ranges of whole neighbouring records in the ZIP files, from their directories and
    indexes. A large archive becomes many ranges, to be read by many tasks."""

    def per_part(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = [r for name in batch.column(0).to_pylist() for r in _ranges(files, base, name)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["archive", "start", "length"],
            )

    return manifest.select("archive").mapInArrow(per_part, "archive string, start long, length long")


def _ranges(files, base: str, name: str) -> list[tuple[str, int, int]]:
    path = f"{base}/{name}"
    with files.open_input_file(path) as file:
        members = {m.name: m for m in directory(file, file.size())}
        data, index = place(file, members[DATA]), members[INDEX]
        lines = _range(file, place(file, index), index.size).decode()
    found: list[list[int]] = []
    for line in io.StringIO(lines):
        at = json.loads(line)
        begin, length = data + at["offset"], at["length"]
        if found and found[-1][0] + found[-1][1] == begin and found[-1][1] < RANGE_BYTES:
            found[-1][1] += length
        else:
            found.append([begin, length])
    return [(name, *f) for f in found]


RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
)


def read_records(ranges: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the ranges, payloads checked against their digests. A revisit has no payload of its own, but
    the length and digest of the one it refers to. Without ``payloads`` these are checked and left out."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def per_part(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with files.open_input_file(f"{base}/{name}") as file:
                    data = _range(file, start, length)
                rows = []
                for whole in members_of(data):
                    row = parse(whole)
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return ranges.mapInArrow(per_part, RECORDS)


def archived(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages written to archives in the shared folder and read back, one row a page, with the columns of `RECORDS`.

    Defined cases: a null html is an empty payload, always a response. A null url stays null. A null page_id
    counts as least of all; rows that share the greatest page_id of their payload are all responses, also equal rows. No
    rows give no archives and no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch_folder(spark, "archives")
    manifest = scratch.write(write_archives(pages, folder), "manifest")
    # Rows that name files are tiny and what they stand for is not: tasks are dealt out by their number, which
    # adaptive execution leaves alone.
    ranges = scratch.write(record_ranges(manifest.repartition(max(1, manifest.count())), folder), "ranges")
    scratch.drop("manifest")
    tasks = math.ceil(ranges.count() / RANGES_PER_TASK) or 1
    return read_records(ranges.repartition(tasks), folder, payloads)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), t AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""
