"""Token-id files in Simple-8b coding.

A 64-bit word has a four-bit selector in its top bits and packs as many ids as fit into 60 bits at equal
width.  Selector 0 is the escape: its payload is a place in the segment's list of ids wider than 60 bits.
Coding restarts every ``BLOCK`` ids, and each block's first word is kept, so blocks are coded in
step as array lanes and decoded alone or together without a loop over words.

A file is a row of segments, each led by its length in bytes, so writer and reader hold one segment at a time.
Segment: magic and version (8 bytes) | words | escapes | document keys | document lengths | first word of each
block | lengths of these five arrays and the number of ids (6 x 8 bytes) | magic.
All values are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import open_fs, shared_folder, stored
from .tokens import UnitEncoder

MAGIC = b"S8BIDS01"
BLOCK = 1024

#: Ids per word and bits per id of each selector; selector 0 is the escape.
COUNTS = np.array([1, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


_NARROW = np.repeat(np.arange(17), [1, *(1 << np.arange(16))]).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return _NARROW[ids.astype(np.uint16)]
    width = np.zeros(len(ids), np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        more = high > 0
        width += more.astype(np.uint8) * np.uint8(step)
        rest = np.where(more, high, rest)
    return width + (rest > 0).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and the first word of each block."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    reach = int(COUNTS.max())
    # a row per block; beyond its end stand zeros, which decoding cuts off
    flat = np.zeros(blocks * BLOCK, ids.dtype)
    flat[:n] = ids
    grid = np.zeros((blocks, BLOCK + reach), ids.dtype)
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = np.zeros(grid.shape, np.uint8)
    width[:, :BLOCK] = _widths(flat).reshape(blocks, BLOCK)
    share = np.cumsum(np.bincount(width[:, :BLOCK].ravel(), minlength=65)) / (blocks * BLOCK)
    sought = [s for s in range(15, 0, -1) if BITS[s] >= 10 or share[BITS[s]] >= 1 / 256]  # rarer runs are not looked for
    span = BLOCK + int(COUNTS[sought].max()) - 1
    widest, have = width[:, :span], 1
    selector = np.zeros((blocks, BLOCK), np.uint8)
    for s in sought:
        count = int(COUNTS[s])
        while have < count:
            more = min(have, count - have)
            widest, have = np.maximum(widest[:, : widest.shape[1] - more], widest[:, more:]), have + more
        np.copyto(selector, np.uint8(s), where=widest[:, :BLOCK] <= BITS[s])
    length = np.full(blocks, BLOCK)
    length[-1] = n - BLOCK * (blocks - 1)
    lane, at, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(lane):
        chosen = selector[lane, at]
        steps.append((lane, at, chosen))
        at = at + COUNTS[chosen]
        go = at < length[lane]
        if not go.all():
            lane, at = lane[go], at[go]
    lanes, starts, chosen = (np.concatenate(x) for x in zip(*steps))
    per_block = np.bincount(lanes, minlength=blocks)
    first = np.cumsum(per_block) - per_block
    place = first[lanes] + np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])  # a block gives one word a step
    words = np.zeros(len(place), np.uint64)
    base = lanes * grid.shape[1] + starts
    wide = grid.ravel()
    for s in range(1, 16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        for k in range(COUNTS[s] if BITS[s] else 0):
            word |= wide[base[mine] + k].astype(np.uint64) << np.uint64(k * BITS[s])
        words[place[mine]] = word
    mine = np.flatnonzero(chosen == 0)
    mine = mine[np.argsort(place[mine])]
    words[place[mine]] = np.arange(len(mine), dtype=np.uint64)
    return words, wide[base[mine]].astype(np.uint64), first


def decode(words: np.ndarray, escapes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ids of a segment, all blocks at once."""
    if not n:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    stride = BLOCK + int(COUNTS.max())  # the last word of a block may reach beyond its end
    starts = block * stride + before - before[first][block]
    out = np.zeros(len(first) * stride, np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if not len(mine):
            continue
        mask, word, to = np.uint64((1 << int(BITS[s])) - 1), words[mine], starts[mine]
        for k in range(COUNTS[s]):
            out[to + k] = (word >> np.uint64(k * BITS[s])) & mask
    mine = np.flatnonzero(chosen == 0)
    out[starts[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out.reshape(len(first), stride)[:, :BLOCK].ravel()[:n]


def pack_segment(keys: np.ndarray, lengths: np.ndarray, words: np.ndarray, escapes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The parts of a segment, led by its length."""
    arrays = [words.astype("<u8"), escapes.astype("<u8"), keys.astype("<i8"), lengths.astype("<i8"), first.astype("<i8")]
    sizes = np.array([*map(len, arrays), int(lengths.sum())], "<i8")
    parts = [MAGIC, *(a.tobytes() for a in arrays), sizes.tobytes(), MAGIC]
    return [np.array(sum(map(len, parts)), "<i8").tobytes(), *parts]


def unpack_segment(blob: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document keys, lengths and all ids of a segment (without its leading length); damage is an error."""
    if bytes(blob[:8]) != MAGIC or bytes(blob[-8:]) != MAGIC:
        raise ValueError("not a token-id file")
    sizes = np.frombuffer(blob[-56:-8], "<i8")
    arrays, at = [], 8
    for size, kind in zip(sizes[:5], ("<u8", "<u8", "<i8", "<i8", "<i8")):
        arrays.append(np.frombuffer(blob[at : at + 8 * size], kind))
        at += 8 * int(size)
    words, escapes, keys, lengths, first = arrays
    return keys, lengths, decode(words, escapes, first, int(sizes[5]))


MANIFEST = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("docs", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)


def write_ids(docs: DataFrame, tokenizer: str, *, keeps_blanks: bool, lower: bool, key: str = "doc_id", text: str = "text", end: int = 1) -> DataFrame:
    """Write token-id files in ascending ``key`` order and return their manifest, with each file's first token.

    Texts are dealt by key ranges and sorted within each; a task writes one file, under a name of its own
    attempt.  The manifest is stored, so only files of tasks that ended count, and a repeated task leaves
    at worst an unlisted file.  A null text is empty; a null key is an error; rows of equal key follow each other.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.of(tokenizer, keeps_blanks, lower)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{attempt}.s8b"
        docs = tokens = size = 0
        with fs.open_output_stream(f"{base}/{name}") as sink:
            for batch in batches:
                keys = batch.column(0)
                if keys.null_count:
                    raise ValueError(f"null {key}")
                keys = keys.to_numpy(zero_copy_only=False)
                for row, last, ids, bounds in encoder.encode(batch.column(1), end):
                    for piece in pack_segment(keys[row:last], np.diff(bounds), *encode(ids)):
                        sink.write(piece)
                        size += len(piece)
                    docs, tokens = docs + last - row, tokens + len(ids)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, f"{folder}/{name}", docs, tokens, size)], names=MANIFEST.names)

    ordered = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).repartitionByRange(parts, key).sortWithinPartitions(key)
    manifest = stored(ordered.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


DOCUMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_ids(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and with ``with_ids`` their ids."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else DOCUMENT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = open_fs(path)
                with fs.open_input_stream(place) as source:
                    while head := source.read(8):
                        keys, lengths, ids = unpack_segment(memoryview(source.read(int(np.frombuffer(head, "<i8")[0]))))
                        bounds = np.concatenate([[0], np.cumsum(lengths)])
                        narrow = ids.astype("<u4")
                        sums = [zlib.crc32(narrow[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                        columns = [pa.array(keys), pa.array(bounds[:-1] + base), pa.array(lengths), pa.array(sums, pa.int64())]
                        if with_ids:
                            columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64())))
                        base += len(ids)
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    spark = manifest.sparkSession
    files = manifest.select("path", "first_token")
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, schema)
