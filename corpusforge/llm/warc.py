"""WARC archives: writer, and a splittable reader (operator 4).

Every record is a gzip member of its own. The reader deals out byte ranges of
the files, whatever their extension: a task looks for the gzip magic in its
range, accepts a place if the bytes there decode to a WARC header, owns the
records that start inside its range and reads past its end to finish the last.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20  # bytes of a task's range
LEAST_REVISIT = 1000  # bytes; equal payloads below this are stored again
_BLOB = 4 << 20  # bytes of members that one written row holds
_READ = 1 << 20
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)


def _record(id_: object, url: str | None, kind: str, refers_to: object, digest: str, payload: bytes) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head without the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:row:{'null' if id_ is None else id_}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:row:{refers_to}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = bytearray()
    for batch in batches:
        for id_, url, payload, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
            kind = "revisit" if refers_to.is_valid else "response"
            held += _record(id_.as_py(), url.as_py(), kind, refers_to.as_py(), digest.as_py(), payload.as_py())
            if len(held) >= _BLOB:
                yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["value"])
                held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str, url_col: str, payload_col: str) -> None:
    """Write a record for every row of ``pages`` to new archive files under ``path``.

    The payload is the column's UTF-8 (null: no bytes). Of records with equal
    payloads of at least ``LEAST_REVISIT`` bytes, that with the largest id (and
    any row that repeats it) is a response and the others revisit it. A null id
    is below every other. A null url has no target header; control characters
    and blanks of a url are percent-encoded.

    Spark's text writer writes the members, so task commits, retries and the
    file system are Spark's; its line separator is an empty gzip member, one
    after every 4 MB or so. Only digests that occur twice are joined back."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    repeated = (
        rows.where(large).groupBy("digest").agg(F.count("*").alias("times"), F.max("id").alias("kept")).where("times > 1")
    ).select("digest", "kept")
    rows = rows.join(repeated, "digest", "left")
    rows = rows.withColumn("refers_to", F.when(~F.col("kept").eqNullSafe(F.col("id")), F.col("kept")))
    blobs = rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(_members, "value binary")
    separator = _EMPTY_MEMBER.decode("latin-1")
    blobs.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


def _open(path: str):
    """The file by Arrow's file systems (local, S3, GCS, HDFS), at its URI."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, name = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(name)


def _member(file, data: bytes, at: int, base: int) -> tuple[bytes, int] | None:
    """(content, place after it) of the member at ``data[at:]``; None if the
    bytes there don't decode to a WARC header (or to nothing, an empty member)."""
    inflate = zlib.decompressobj(31)
    out, chunk, known = [], data[at : at + _READ], False
    fed = base + at + len(chunk)  # the place after what has been inflated
    try:
        while True:
            part = inflate.decompress(chunk)
            if part:
                out.append(part)
            if not known and (sum(map(len, out)) >= 5 or inflate.eof):
                start = b"".join(out)
                if not start.startswith(b"WARC/") and (start or not inflate.eof):
                    return None
                known = True
            if inflate.eof:
                return b"".join(out), fed - len(inflate.unused_data)
            file.seek(fed)
            chunk = file.read(_READ)
            fed += len(chunk)
            if not chunk:
                break
    except zlib.error:
        if not known:
            return None
        raise
    if known:
        raise ValueError(f"a record that starts at byte {base + at} is cut off")
    return None


def records_of_range(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end)."""
    with _open(path) as file:
        file.seek(start)
        data = file.read(end - start + len(MAGIC) - 1)
        at = 0
        while (at := data.find(MAGIC, at)) >= 0 and start + at < end:
            found = _member(file, data, at, start)
            if found is None:
                at += 1
                continue
            if found[0]:
                yield start + at, found[0]
            at = found[1] - start
            if at >= len(data):
                break


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(content: bytes) -> tuple:
    """(type, id, uri, refers to, digest, payload bytes, payload) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    named = _headers(head.split(b"\r\n")[1:])
    block = rest[: int(named.get("content-length", len(rest)))]
    http: dict[str, str] = {}
    if named.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = _headers(top.split(b"\r\n")[1:])
    kind = named.get("warc-type")
    revisit = kind == "revisit"
    size = int(http.get("content-length", 0)) if revisit else len(block)
    digest = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (kind, named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-refers-to"), digest, size, None if revisit else block)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, held = [], 0
            for offset, content in records_of_range(path, start, end):
                rows.append((path, offset, *parse_record(content)))
                held += len(content)
                if held >= _BLOB:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of all files under ``path``, each once: ``RECORD_SCHEMA``.

    ``payload`` is the HTTP body, or the block of a record of another kind; a
    revisit has none, and its ``payload_bytes`` and ``payload_digest`` are what
    its headers say of the payload it stands for. Empty files and empty members
    hold no record; a record that is cut off raises. A range never loses or
    repeats a record, wherever its borders fall. Files that hold archives as
    uncompressible payloads could show those as records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.where("length > 0").select("path", "length", starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks).mapInArrow(_read, RECORD_SCHEMA)
