"""WARC archives: written from rows, and read back by a splittable reader.

An archive is a file of gzip members, one per record. The reader plans byte ranges over the files;
a task looks for gzip magic in its range, accepts a candidate only if it decodes to a record header,
and owns the records that start inside its range, reading past the end where it must. So a large
archive is read by many tasks without an index.

Files are reached through pyarrow's file systems by URI, in the session's shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import shared_folder

SPLIT_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
LONGEST_HEADER = 1 << 16


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit has no block; the response it refers to holds the payload.

    A NULL id has no identity line; line breaks in a URL are left out of its header.
    """
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    block = payload if refers_to is None else b""
    lines.append(f"Content-Length: {len(block)}")
    head = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-cased, and block of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode()
    return fields, rest[: int(fields["content-length"])]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, url, payload binary, digest, refers_to) and return (path, bytes, records).

    A task writes one file under a name of its own, so a repeated task leaves the first file unread:
    only the files listed in the result count. A task without rows writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, top = fs.FileSystem.from_uri(folder)
        place.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = place.open_output_stream(f"{top}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        write, "path string, bytes long, records long"
    )


def _decoded(file, start: int, size: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The gzip member at `start` and where it ends, or its first `most` bytes; None if it is none."""
    unpack = zlib.decompressobj(31)
    parts, have, at = [], 0, start
    while at < size:
        file.seek(at)
        chunk = file.read(min(1 << 16 if most or not parts else CHUNK_BYTES, size - at))
        try:
            data = unpack.decompress(chunk, most - have if most else 0)
        except zlib.error:
            return None
        parts.append(data)
        have, at = have + len(data), at + len(chunk)
        if unpack.eof:
            return b"".join(parts), at - len(unpack.unused_data)
        if most and have >= most:
            return b"".join(parts), at
    return (b"".join(parts), size) if most and have else None


def records_in_range(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded records whose member starts in [start, end)."""
    at, end = start, min(end, size)
    while at < end:
        file.seek(at)
        window = file.read(min(CHUNK_BYTES, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        head = _decoded(file, at, size, len(VERSION))
        whole = _decoded(file, at, size) if head and head[0].startswith(VERSION) else None
        if whole is None:
            at += 1
            continue
        yield whole[0]
        at = whole[1]


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload_bytes, payload_digest) of every record.

    `manifest` has (path, bytes). `digest` is the header's; `payload_bytes` and `payload_digest` are
    taken from the block and NULL for revisits. An empty manifest gives no rows.
    """
    ranges = manifest.select(
        "path",
        F.col("bytes").alias("size"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"),
    )
    # one range is one task's worth of bytes; deal them out evenly
    ranges = ranges.repartition(spark.sparkContext.defaultParallelism * 2, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def identity(value: str | None) -> int | None:
            return int(value[len("<urn:page:") : -1]) if value else None

        for batch in batches:
            for row in batch.to_pylist():
                place, path = fs.FileSystem.from_uri(row["path"])
                out: list[dict] = []
                with place.open_input_file(path) as file:
                    for data in records_in_range(file, row["start"], row["start"] + split_bytes, row["size"]):
                        fields, block = parse(data)
                        response = fields["warc-type"] == "response"
                        out.append(
                            {
                                "page_id": identity(fields.get("warc-record-id")),
                                "record_type": fields["warc-type"],
                                "refers_to": identity(fields.get("warc-refers-to")),
                                "digest": fields["warc-payload-digest"].removeprefix("sha256:"),
                                "payload_bytes": len(block) if response else None,
                                "payload_digest": hashlib.sha256(block).hexdigest() if response else None,
                            }
                        )
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("digest", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
        ]
    )
    return ranges.mapInArrow(
        read,
        "page_id long, record_type string, refers_to long, digest string, payload_bytes long, payload_digest string",
    )


def archive_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/riskloom/{uuid.uuid4().hex}"
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
