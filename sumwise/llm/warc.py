"""WARC archives under Zstandard: written by tasks, read back record by record.

An archive starts with a skippable frame that holds the dictionary of all later frames; its
magic number is fixed by the WARC-Zstandard convention.  Every record after it is one frame of
its own, so a reader can stop and resume between records.  Each task writes archives of about
ROLL_BYTES and trains a dictionary on the first SAMPLE_BYTES of payload of each archive.
A task names its files anew at every attempt, and the list of archives is written by Spark,
so what a lost task leaves behind is never read.

Of records with equal payloads of at least `least` bytes, the one with the largest id is
written in full (response), the others point to it (revisit).  Groups are found by digest,
combined before the shuffle; a payload that a third of the pages share makes one row there.

Reading decodes one frame at a time, in blocks, and checks the version, the required fields,
the length of the record, both digests and the length of the payload.  An archive that fails
raises ValueError: a damaged archive never passes as a shorter one.

Edge cases: a null or empty payload is a record of 0 bytes.  A null URL leaves the field out,
control characters and blanks in a URL are percent-encoded.  A null id is written without id
and never is referred to while its group has others; in a group of null ids all are responses.
Rows that repeat the largest id of their group are all responses.  An empty table gives no
archives and an empty result; further columns are ignored.  Memory grows with one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwise.functions.basics import new_folder, stored
from sumwise.llm.common import slices

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROLL_BYTES = 32 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 3

FIELDS = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, archive string"
ARROW_FIELDS = pa.schema(
    [(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (f.split() for f in FIELDS.split(", "))]
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{id}/{digest}'.encode()).digest())}>"


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{name}: {value}".encode() for name, value in head.items() if value is not None)]
    return b"\r\n".join([*lines, b"", block, b"", b""])


def page_record(id: str | None, url: str | None, payload: bytes, refers_to: str | None, refers_url: str | None, date: str) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()

    def plain(u):
        return u if u is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u)

    fields = {
        "WARC-Record-ID": record_id(id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": plain(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Page-ID": id,
    }
    if refers_to is None:
        return record("response", fields, http + payload)
    fields |= {
        "WARC-Profile": REVISIT_PROFILE,
        "WARC-Refers-To": record_id(refers_to, digest),
        "WARC-Refers-To-Target-URI": plain(refers_url),
        "WARC-Refers-To-Date": date,
        "Refers-To-Page-ID": refers_to,
    }
    return record("revisit", fields, http)


def dictionary_of(samples: list[bytes]) -> bytes:
    """Trained on the samples; nothing where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """One archive on the way: holds back the first records until the dictionary is trained."""

    def __init__(self, folder: str, date: str):
        fs, root = FileSystem.from_uri(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = fs.open_output_stream(f"{root}/{self.path.rpartition('/')[2]}", compression=None)
        self.held: list[bytes] | None = [
            record("warcinfo", {"WARC-Record-ID": record_id(None, self.path), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
        ]
        self.held_bytes = self.records = self.size = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.held is None:
            self.frame(data)
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        known = dictionary_of(self.held)
        self.write(struct.pack("<II", DICTIONARY_MAGIC, len(known)) + known)
        chosen = zstandard.ZstdCompressionDict(known) if known else None
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=chosen, write_checksum=True)
        held, self.held = self.held, None
        for data in held:
            self.frame(data)

    def frame(self, data: bytes) -> None:
        self.write(self.zip.compress(data))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self.start()
        self.out.close()
        return self.path, self.records, self.size


def frames(source, archive: str) -> Iterator[bytes]:
    """The content of each frame after the leading dictionary."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        raise ValueError(f"{archive}: no leading dictionary frame")
    length = struct.unpack("<II", head)[1]
    known = source.read(length)
    if len(known) < length:
        raise ValueError(f"{archive}: the dictionary is cut off")
    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
    block, one, parts = source.read(BLOCK_BYTES), None, []
    while block:
        one = one or unzip.decompressobj()
        parts.append(one.decompress(block))
        if one.eof:
            yield b"".join(parts)
            block, one, parts = one.unused_data, None, []
        else:
            block = b""
        block = block or source.read(BLOCK_BYTES)
    if one is not None:
        raise ValueError(f"{archive}: the last frame is cut off")


def parsed(data: bytes, archive: str) -> dict | None:
    """The checked fields of a record; None for records that describe the archive."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(line.decode().partition(": ")[::2] for line in lines)

    def check(good: bool, what: str) -> None:
        if not good:
            raise ValueError(f"{archive}: {fields.get('WARC-Record-ID')}: {what}")

    check(version == VERSION and bool(gap), "not a record of this version")
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        check(name in fields, f"{name} is missing")
    check(fields["Content-Length"].isdecimal() and len(rest) == int(fields["Content-Length"]) + 4, "wrong length")
    check(rest.endswith(b"\r\n\r\n"), "no end of record")
    block = rest[:-4]
    check(fields.get("WARC-Block-Digest") == f"sha1:{base32_sha1(block)}", "wrong block digest")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^Content-Length: *(\d+)\r?$", http)
    check(bool(gap) and size is not None, "no HTTP header with a length")
    digest = fields.get("WARC-Payload-Digest", "")
    if kind == "response":
        check(len(payload) == int(size[1]), "wrong payload length")
        check(digest == f"sha1:{base32_sha1(payload)}", "wrong payload digest")
    else:
        check(not payload and fields.get("WARC-Profile") == REVISIT_PROFILE, "not a revisit of this profile")
        check("WARC-Refers-To" in fields and "Refers-To-Page-ID" in fields, "it refers to nothing")
    return {
        "id": fields.get("Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": int(size[1]),
        "payload_digest": digest.removeprefix("sha1:"),
        "refers_to": fields.get("Refers-To-Page-ID"),
        "payload": payload if kind == "response" else None,
        "archive": archive,
    }


def write_archives(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes the pages into a new folder of the shared one; (path, records, bytes) of every archive."""
    folder = new_folder(pages.sparkSession)
    rows = pages.select(
        F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")
    )
    digest = F.when(F.octet_length("html") >= least, F.sha1("html"))
    groups = rows.select("id", "url", digest.alias("digest")).where("digest is not null").groupBy("digest")
    first = groups.agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1 and first.id is not null")
    joined = rows.withColumn("digest", digest).join(first, "digest", "left")
    other = ~F.col("id").eqNullSafe(F.col("first.id")) & F.col("first.id").isNotNull()
    chosen = joined.select(
        F.col("id").cast("string").alias("id"),
        "url",
        "html",
        F.when(other, F.col("first.id")).cast("string").alias("refers_to"),
        F.when(other, F.col("first.url")).alias("refers_url"),
    )

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        FileSystem.from_uri(folder)[0].create_dir(FileSystem.from_uri(folder)[1], recursive=True)
        archive = None
        done = []
        for batch in slices(batches, "html", 4 << 20):
            for row in batch.to_pylist():
                archive = archive or Archive(folder, date)
                archive.add(page_record(row["id"], row["url"], row["html"].encode(), row["refers_to"], row["refers_url"], date))
                if archive.size >= ROLL_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])

    return stored(chosen.mapInArrow(written, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """One row of FIELDS per page record of the archives in column `path`; payloads only if wanted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(where, compression=None) as source:
                    for data in frames(source, path):
                        row = parsed(data, path)
                        if row is None:
                            continue
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_FIELDS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_FIELDS)

    tasks = min(max(1, archives.count()), 10_000)
    return archives.select("path").repartition(tasks).mapInArrow(read, FIELDS)


def archive_digests(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages, reads the archives back: `id`, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[id].dataType
    found = read_archives(write_archives(pages, id, url, html, least), payload=False)
    return found.select(
        F.col("id").cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
