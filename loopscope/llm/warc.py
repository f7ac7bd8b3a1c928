"""WARC archives: written from rows, and read back by byte ranges.

Every record is a gzip member of its own, as the format asks for. Archives go through Spark's
text writer, and so to any file system and by its commit protocol: a member's last byte is the top
byte of its length, zero below 16 MiB, and the writer's line end is that byte. A longer record is
followed by an empty member, whose last byte is zero too.

The reader cuts archives into byte ranges. A task looks for gzip's magic number from its range's
start on, takes a candidate if it decodes to the start of a WARC header, whole and with another
member or the file's end behind it, and then owns every record that starts inside its range; the
last of them may end beyond it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.llm.tables import Stored, new_folder

#: The parts of the formats that the reader and the writer share.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a range, and bytes read at a time.
RANGE, CHUNK = 4 << 20, 1 << 18
#: Parts that the rows of one payload are dealt to when they look up their response.
PARTS = 64
DATE = "2024-01-01T00:00:00Z"

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, path string, start long"


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """One record, as a gzip member that ends in a zero byte (maybe that of an empty member behind it)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"\s+", "%20", url)))
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    member = gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)
    return member if member[-1] == 0 else member + gzip.compress(b"", mtime=0)


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, path: str | None = None) -> str:
    """Write a record for every row and return the folder of archives.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest id becomes a
    response and the others revisit it; smaller payloads are all responses. A null payload counts as
    empty, a null url is left out. Rows that repeat the largest id are responses too; rows without
    an id are never revisited unless no other row has their payload, and then are all responses.
    Other columns are not used. An empty table gives an empty folder.
    """
    path = path or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # Only payloads that occur twice need a look-up; its key is salted, for one may be a third of all rows.
    equal = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null")
    equal = Stored(equal.select(F.col("digest").alias("d"), "to", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")), "payloads").df
    own = rows.withColumn("own", F.pmod(F.xxhash64("id", "url"), F.lit(PARTS)).cast("int"))
    joined = own.join(equal, (F.col("digest") == F.col("d")) & (F.col("own") == F.col("part")), "left")
    refers = F.when(F.col("to").isNotNull() & ~F.col("to").eqNullSafe(F.col("id")), F.col("to"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                made = []
                for row_id, url, payload, to in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    # The line end that follows is the member's last byte.
                    made.append(record_of(_name(row_id), url, payload, None if to is None else _name(to))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    members = joined.select("id", "url", "payload", refers.alias("to")).mapInArrow(make, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    return path


def _name(row_id: int | None) -> str:
    return f"urn:page:{'' if row_id is None else row_id}"


class _Archive:
    """An archive's bytes by position."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" not in path:
            path = re.sub(r"^file:/+|^/+", "file:///", path)
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def at(self, start: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - start)), start)


def _member(archive: _Archive, start: int, most: int | None = None) -> tuple[bytes, int] | None:
    """What the gzip member at ``start`` holds, at most its first ``most`` bytes, and where it ends (or None)."""
    inflate, parts, at, n = zlib.decompressobj(31), [], start, 0
    try:
        while not inflate.eof:
            data = archive.at(at, CHUNK if most is None else 512)
            if not data:
                return None
            parts.append(inflate.decompress(data))
            at, n = at + len(data), n + len(parts[-1])
            if most is not None and n >= most:
                break
    except zlib.error:
        return None
    return b"".join(parts), at - len(inflate.unused_data)


def _starts_record(archive: _Archive, at: int) -> bool:
    head = _member(archive, at, len(VERSION))
    return head is not None and head[0].startswith(VERSION)


def _follows(archive: _Archive, at: int) -> bool:
    return at >= archive.size or archive.at(at, 3) == MAGIC


def records_in(archive: _Archive, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of every record that starts from ``start`` on and before ``end``."""
    at, known = start, False
    while at < end:
        if not known:
            # Look for the magic number; it may cross the range's end by two bytes.
            data = archive.at(at, min(CHUNK, end - at) + 2)
            found = data.find(MAGIC)
            if found < 0:
                at += max(1, len(data) - 2)
                continue
            at += found
            if at >= end:
                return
            if not _starts_record(archive, at):
                at += 1
                continue
        whole = _member(archive, at) if archive.at(at, 3) == MAGIC else None
        if whole is None or not known and not _follows(archive, whole[1]):
            at, known = at + 1, False
            continue
        if whole[0].startswith(VERSION):
            yield at, whole[0]
        at, known = whole[1], True


def parse(record: bytes) -> dict[str, object]:
    """The fields of one record; the payload is what follows the block's HTTP header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, refers = fields.get("warc-type"), fields.get("warc-refers-to")
    length = len(payload)
    if kind == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length, payload = int(said[1]) if said else None, None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if payload is not None and digest is not None and digest != digest_of(payload):
        raise ValueError(f"the payload of {fields.get('warc-record-id')} is not what its digest says")
    return {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": refers and refers.strip("<>"), "payload_digest": digest, "payload_bytes": length, "payload": payload}


def read_archives(spark: SparkSession, path: str, *, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """A row for every record of the archives in the folder ``path``; the payload of revisits is null."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "length")
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("start", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for at, record in records_in(_Archive(file), start, end):
                    row = parse(record) | {"path": file, "start": at}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 1000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, spark.sparkContext.defaultParallelism)
    return ranges.repartition(n * 4, "path", "start").mapInArrow(read, RECORD).select(*names)


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = read_archives(pages.sparkSession, write_archives(pages, **options), payloads=False)
    row_id = lambda name: F.expr(f"cast(nullif(substring({name}, 10), '') as long)")
    return found.select(row_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", row_id("refers_to").alias("refers_to"))
