"""Web archives: revisit resolution and deduplicated WARC files.

Headers (key, digest, size) are shuffled by payload digest; of equal payloads of at least ``min_bytes`` the
record with the largest key stays a response and the others become revisit records that refer to it.  Groups
are maxima with map-side merging, so a digest that a third of the pages share is one row per task; its members
are found by a join on (key, digest), never gathered.

Archives are written by the tasks, a gzip member per record with fresh headers.  A revisit record keeps the
HTTP headers of its response, and so the payload's length.  A file carries the name of its attempt and counts only
if the stored manifest lists it, so lost executors and repeated tasks leave no double records.

Defined results: a null or empty payload is a response with no bytes; a record without key is a response whose
id is its digest; rows of equal key and payload keep the type that their payload gives them; a null address is
replaced by the record's id, and line breaks in an address are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import open_fs, shared_folder, stored

MIN_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROWS = 64

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("refers_to_uri", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def payloads(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """Key, address, payload bytes and digest of each page."""
    data = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).cast("string").alias("uri"), data.alias("payload"), F.sha1(data).alias("digest"))


def resolve_revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to, refers_to_uri) of the records that repeat an earlier payload."""
    headers = records.where(F.octet_length("payload") >= min_bytes).select("page_id", "uri", "digest")
    groups = (
        headers.groupBy("digest")
        .agg(F.max(F.struct("page_id", "uri")).alias("original"), F.count("*").alias("copies"))
        .where("copies > 1 AND original.page_id IS NOT NULL")
        .select("digest", F.col("original.page_id").alias("refers_to"), F.col("original.uri").alias("refers_to_uri"))
    )
    return headers.join(groups, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to", "refers_to_uri").distinct()


def _record(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + deflate.flush()


def _address(uri: str | None, name: str) -> str:
    return uri.replace("\r", "%0D").replace("\n", "%0A") if uri else name


def _name(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{page_id}" if page_id is not None else f"urn:sha1:{digest}"


def write_archives(pages: DataFrame, *, key: str = "page_id", uri: str = "url", body: str = "html", min_bytes: int = MIN_BYTES, level: int = 5, date: str | None = None) -> DataFrame:
    """Write deduplicated archives; the stored manifest of their files comes back."""
    folder = shared_folder(pages.sparkSession, "warc")
    when = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = payloads(pages, key, uri, body)
    revisits = resolve_revisits(records, min_bytes)
    joined = records.join(revisits, ["page_id", "digest"], "left").select("page_id", "uri", "digest", "payload", "refers_to", "refers_to_uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        count = size = 0
        with fs.open_output_stream(f"{base}/{name}") as sink:
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", when), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
            sink.write(info)
            size += len(info)
            for batch in batches:
                columns = [c.to_pylist() for i, c in enumerate(batch.columns) if i != 3]
                for i, (page, address, digest, to, to_address) in enumerate(zip(*columns)):
                    payload = batch.column(3)[i].as_py()
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    fields = [
                        ("WARC-Type", "response" if to is None else "revisit"),
                        ("WARC-Record-ID", f"<{_name(page, digest)}>"),
                        ("WARC-Target-URI", _address(address, _name(page, digest))),
                        ("WARC-Date", when),
                        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
                        ("Content-Type", "application/http;msgtype=response"),
                    ]
                    if to is None:
                        block += payload
                    else:
                        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_name(to, digest)}>"), ("WARC-Refers-To-Target-URI", _address(to_address, _name(to, digest)))]
                    packed = _record(fields, block, level)
                    sink.write(packed)
                    count, size = count + 1, size + len(packed)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (f"{folder}/{name}", count, size)], names=MANIFEST.names)

    return stored(joined.mapInArrow(run, MANIFEST), "warc-manifest")


def _members(source) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    inflate, parts = zlib.decompressobj(31), []
    while data := source.read(1 << 20):
        while data:
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive ends inside a record")


def _parse(record: bytes) -> dict[str, str | bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str | bytes] = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    fields["block"] = rest[: int(fields["content-length"])]
    return fields


def _page(name: str | None) -> int | None:
    return int(name[len("<urn:x-page:") : -1]) if name and name.startswith("<urn:x-page:") else None


def read_archives(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of the archives; a payload that does not match its digest is an error."""
    schema = T.StructType(RECORD.fields if with_payload else RECORD.fields[:-1])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(schema)]

    def rows(path: str) -> Iterator[tuple]:
        fs, place = open_fs(path)
        with fs.open_input_stream(place) as source:
            for fields in map(_parse, _members(source)):
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                head, _, payload = fields["block"].partition(b"\r\n\r\n")
                size = int(head.lower().rpartition(b"content-length: ")[2].split(b"\r\n")[0])
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"damaged payload in {path}: {fields['warc-record-id']}")
                row = (_page(fields["warc-record-id"]), kind, fields["warc-target-uri"], digest, size, _page(fields.get("warc-refers-to")), fields.get("warc-refers-to-target-uri"))
                yield (*row, payload if kind == "response" else None) if with_payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found: list[tuple] = []
                for row in rows(path):
                    found.append(row)
                    if len(found) == _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=schema.names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=schema.names)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(parts).mapInArrow(run, schema)
