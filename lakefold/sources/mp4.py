"""MP4 files as box rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .archive import _batches, _files, arrow_stage

BOX_SCHEMA = "path STRING, box_no INT, depth INT, track INT, box_type STRING, offset BIGINT, size BIGINT, payload BINARY, error STRING"
_ARROW = pa.schema([("path", pa.string()), ("box_no", pa.int32()), ("depth", pa.int32()), ("track", pa.int32()), ("box_type", pa.string()),
                    ("offset", pa.int64()), ("size", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta"}
_KEPT = {b"mvhd", b"tkhd", b"hdlr", b"ftyp"}


def _boxes(path: str, data: bytes | None) -> Iterator[tuple]:
    data = data or b""
    stack, number, track = [(0, len(data), 0)], 0, 0
    while stack:
        at, end, depth = stack.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1 and at + 16 <= end:
            size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < header or at + size > end:
            yield (path, number, depth, None, None, at, size, None, "box size out of range")
            continue
        track += kind == b"trak"
        payload = data[at + header:at + size] if kind in _KEPT else None
        yield (path, number, depth, track or None, kind.decode("latin-1"), at, size, payload, None)
        number += 1
        stack.append((at + size, end, depth))
        if kind in _CONTAINERS:
            stack.append((at + header, at + size, depth + 1))


def mp4_boxes(files: DataFrame) -> DataFrame:
    """Boxes in file order with depth and track number; header boxes keep their payload."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in _files(batches):
            yield from _boxes(path, content)

    return arrow_stage(files.select("path", "content"), lambda b: _batches(rows(b), _ARROW, lambda r: len(r[7] or b"")), BOX_SCHEMA)
