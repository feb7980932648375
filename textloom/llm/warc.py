"""WARC archives: write one gzip member per record, and read archives back in byte ranges.

Writing: each task writes its records to archives of its own in the shared folder, under a name that no other attempt
has, and gives their paths and sizes as rows; only the rows of attempts that succeed reach the manifest, so what a lost
task has left is never read. Among records with equal payloads of at least `revisit_from` bytes the one with the largest
id is the response and the others revisit it; the largest id of a digest is an aggregate that combines before the
shuffle, and the join to it is one that Spark can split where a digest is hot.

Reading: archives are cut into ranges. The task of a range looks for the gzip magic in it, takes a place for a member only
if decoding from there gives a WARC header, owns the records that start inside its range, and reads on past its end to
finish the last one. Ranges of one archive need nothing of each other. Where a record ends, the next one starts or the archive
ends; anything else there is an error, also beyond the range, so damage costs no record in silence.

Defined cases: a null payload is empty; a null id is written as an empty one and read back as null, and its records are
responses; rows that repeat an id and a payload are responses all, if that id is the largest; line breaks in a URL are
percent-encoded; an empty table writes no archive and reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_list, new_path, prepare, written

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
_ID = "<urn:textloom:page:%s>"
_FIELDS = "record_type string, url string, page_id bigint, refers_to bigint, payload_digest string, payload_bytes bigint"


def open_file(path: str, mode: str):
    """A local or mounted path is opened as it is; other schemes through Arrow's file systems."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        import os

        local = unquote(where.path)
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner, compression=None) if "w" in mode else store.open_input_file(inner)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP header, whose length is that of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        "WARC-Record-ID: " + _ID % ("" if page_id is None else page_id),
        "WARC-Date: " + date,
        "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: "%%%02X" % ord(m[0]), url or ""),
        "WARC-Payload-Digest: sha1:" + digest,
    ]
    if refers_to is not None:
        head += ["WARC-Refers-To: " + _ID % refers_to, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", "Content-Length: %d" % len(block)]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0, archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archives now; the manifest: path, size, records."""
    spark = pages.sparkSession
    prepare(spark)
    where, date = new_path(spark, "warc"), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(page_id).cast("long").alias("i"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h")).withColumn("d", F.sha1("h"))
    again = rows.filter(F.octet_length("h") >= revisit_from).groupBy("d").agg(F.max("i").alias("last"), F.count("*").alias("n")).filter("n > 1").select("d", "last")
    again = written(again, "repeated")  # few digests, as a rule, so that the pages stay where they are
    ready = rows.join(F.broadcast(again) if again.count() <= 500_000 else again, "d", "left").select("i", "u", "h", F.when(F.col("last") != F.col("i"), F.col("last")).alias("r"), F.unhex("d").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, found = TaskContext.get().partitionId(), None, []
        try:
            for b in batches:
                for i, u, h, r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_list(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    if out is None or found[-1][1] >= archive_bytes:
                        if out is not None:
                            out.close()
                        found.append([f"{where}/part-{part:06d}-{len(found):03d}-{uuid.uuid4().hex}.warc.gz", 0, 0])
                        out = open_file(found[-1][0], "wb")
                    packed = record(i, u, h, r, base64.b32encode(d).decode(), date)
                    out.write(packed)
                    found[-1][1] += len(packed)
                    found[-1][2] += 1
        finally:
            if out is not None:
                out.close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "records"])

    return written(ready.mapInArrow(run, "path string, size bigint, records bigint"), "manifest")


class _Member:
    """Decodes a gzip member from an offset of a file, a piece at a time."""

    def __init__(self, file, at: int, buffered: bytes = b""):
        self.file, self.zip, self.rest, self.pos = file, zlib.decompressobj(31), buffered, at + len(buffered)
        self.out = b""

    def more(self, most: int) -> bool:
        """Decodes up to `most` bytes further; False at the member's or the file's end."""
        if self.zip.eof:
            return False
        if not self.rest:
            self.file.seek(self.pos)
            self.rest = self.file.read(READ)
            self.pos += len(self.rest)
            if not self.rest:
                return False
        self.out += self.zip.decompress(self.rest, most)
        self.rest = self.zip.unconsumed_tail
        return True

    @property
    def end(self) -> int:
        return self.pos - len(self.zip.unused_data)


def _header(file, at: int, buffered: bytes) -> tuple[_Member, dict[str, str], bytes] | None:
    """The member at a place, its WARC header and what of the block came with it; None if there is no such header."""
    member = _Member(file, at, buffered)
    try:
        while b"\r\n\r\n" not in member.out and member.out[:5] == b"WARC/"[: len(member.out)] and member.more(max(1 << 12, len(member.out))):
            pass
        if not member.out.startswith(b"WARC/") or b"\r\n\r\n" not in member.out:
            return None
        head, _, body = member.out.partition(b"\r\n\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
        return (member, fields, body) if int(fields["content-length"]) >= 0 else None
    except (zlib.error, ValueError, KeyError):
        return None


def read_range(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header and block of each record that starts in [start, end).

    A magic that is followed by no WARC header is taken for compressed data, but not where a record has just ended: what follows there
    is another record or the end of the file, and anything else is an error. That holds beyond the range, too, so every record but
    an archive's first is looked for by the one before it, and none is lost in silence.
    """
    with open_file(path, "rb") as file:
        at, due = start, False
        while at < end or due:
            file.seek(at)
            window = file.read(min(READ, end - at) + 2 if at < end else 1 << 14)
            if due:
                k = 0
                if not window:
                    return
            else:
                k = window.find(MAGIC)
                if k < 0 or at + k >= end:
                    if len(window) <= 2 or at + len(window) - 2 >= end:
                        return
                    at += len(window) - 2
                    continue
            at += k
            found = _header(file, at, window[k:])
            if found is None:
                if due:
                    raise ValueError(f"{path}: there is no record at {at}, where one has to start")
                at, due = at + 1, False
                continue
            if at >= end:
                return  # the next range's
            member, fields, body = found
            length = int(fields["content-length"])
            pieces, have = [body], len(body)
            while have < length + 4 or not member.zip.eof:
                member.out = b""
                if not member.more(READ):
                    break
                pieces.append(member.out)
                have += len(member.out)
            if have < length or not member.zip.eof:
                raise ValueError(f"{path}: the record at {at} is cut off")
            yield fields, b"".join(pieces)[:length]
            at, due = member.end, True


def parse(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of a record: type, url, page_id, refers_to, digest and length of the full payload, payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    ident = lambda k: int(m[1]) if (m := re.search(r":page:(-?\d+)>", fields.get(k, ""))) else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if (found := base32_sha1(payload)) != digest:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload's digest is {found}, not {digest}")
        size = len(payload)
    else:
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    return kind, fields.get("warc-target-uri"), ident("warc-record-id"), ident("warc-refers-to"), digest, size, payload


def read_archives(manifest: DataFrame, range_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    """A row per record of the archives (path, size), with its payload unless told otherwise."""
    ranges = manifest.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + range_bytes, "size")).select("path", "start", "end")
    count = manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(max(2 * manifest.sparkSession.sparkContext.defaultParallelism, int(count) // 4), F.xxhash64("path", "start"))
    names = ["record_type", "url", "page_id", "refers_to", "payload_digest", "payload_bytes", *["payload"] * payload]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                rows, size = [], 0
                for fields, block in read_range(path, start, end):
                    rows.append(parse(fields, block)[: len(names)])
                    size += len(block) if payload else 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return ranges.mapInArrow(run, _FIELDS + (", payload binary" if payload else ""))


def check_count(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records, or an error if they are not as many as the manifest states. Takes a pass over them."""
    found, stated = records.count(), manifest.agg(F.sum("records")).first()[0] or 0
    if found != stated:
        raise ValueError(f"the archives gave {found} records, not the {stated} of the manifest")
    return records


def digest(pages: DataFrame) -> DataFrame:
    """The columns that the query returns: every page written to archives and read back, and the number of records compared."""
    manifest = write_archives(pages)
    records = read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return check_count(written(records, "records"), manifest)
