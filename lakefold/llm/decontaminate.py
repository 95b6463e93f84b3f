"""Benchmark decontamination: a broadcast hash set of test windows against every document window.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.  A test
item gives its windows of ``width`` consecutive words; a shorter item gives one window of all its
words, an item without words none.  Document windows whose hash is in the set are verified word by
word; every word inside a verified window is hit.  The pass is map-only: documents are not shuffled.

The test set is read in blocks of at most ``block_bytes`` of text (plus one item); each block is one
broadcast and one chained map over the documents, so the broadcast is bounded whatever the set's size.

Defined results: a null or empty text has no words and no hits; items with a null id or text are
ignored; repeated items count once; an empty test set leaves all documents untouched.  All columns of
the documents pass through; a column with the result's name is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import NOT_ALNUM, Words, buffers, per_row, slices

WIDTH = 10
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 22

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(T.LongType())),  # first and end word of each run of hit words
        T.StructField("clean_text", T.StringType()),
    ]
)


class TestWindows:
    """Windows of a block of test items: sorted hashes, the words behind them and their items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        found: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(dict))
        for item, text in items:
            words = Words(*buffers(pa.array([text])), NOT_ALNUM)
            if not len(words):
                continue
            size = min(width, len(words))
            at, hashes = words.windows(words.hashes(), size)
            for start, h in zip(at.tolist(), hashes.tolist()):
                key = b" ".join(words.text(w) for w in range(start, start + size))
                found[size][h].setdefault(key, set()).add(item)
        self.by_width = {}
        for size, table in found.items():
            hashes = np.sort(np.fromiter(table, np.uint64, len(table)))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_width[size] = (hashes, bits, dict(table))

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Marks of hit words, and the items found in each row."""
        marks = np.zeros(len(words) + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        hashes = words.hashes()
        for size, (known, bits, table) in self.by_width.items():
            at, found = words.windows(hashes, size)
            maybe = np.flatnonzero(bits[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at, found = at[maybe], found[maybe]
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            same = np.flatnonzero(known[place] == found)
            rows = np.searchsorted(words.first, at[same], side="right") - 1
            for start, h, row in zip(at[same].tolist(), found[same].tolist(), rows.tolist()):
                owners = table[h].get(b" ".join(words.text(w) for w in range(start, start + size)))
                if owners:
                    marks[start] += 1
                    marks[start + size] -= 1
                    items[row] |= owners
        return np.cumsum(marks)[:-1] > 0, items


def _scan(windows, text: str, into: str, last: bool):
    """The map over Arrow batches: merge this block's hits into the result column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            before = batch.column(into).to_pylist()
            after = []
            for row, end in slices(offsets):
                words = Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], NOT_ALNUM)
                hit, items = windows.value.hits(words)
                for r in range(row, end):
                    old = before[r]
                    runs = (old or {}).get("runs") or []
                    for a, b in zip(runs[::2], runs[1::2]):
                        hit[words.first[r - row] + a : words.first[r - row] + b] = True
                counts = per_row(hit, words.first)
                for r in range(row, end):
                    lo, hi = words.first[r - row], words.first[r - row + 1]
                    old = before[r] or {}
                    found = sorted(set(old.get("items") or ()) | items.get(r - row, set()))
                    clean, runs = None, []
                    if counts[r - row]:
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8)))
                        runs = edges.tolist()
                        if last:
                            clean = _cut(words, r - row, lo, edges)
                    after.append({"n_words": int(hi - lo), "n_hit": int(counts[r - row]), "items": found, "runs": runs, "clean_text": clean})
            columns = [batch.column(c) if c != into else pa.array(after, batch.schema.field(into).type) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _cut(words: Words, row: int, lo: int, edges: np.ndarray) -> str:
    """The row's text without its runs of hit words (and what stands between them)."""
    parts, at = [], words.offsets[row]
    for a, b in zip(edges[::2], edges[1::2]):
        parts.append(words.raw[at : words.starts[lo + a]].tobytes())
        at = words.ends[lo + b - 1]
    parts.append(words.raw[at : words.offsets[row + 1]].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def find_test_windows(
    docs: DataFrame,
    tests: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    into: str = "leak",
) -> DataFrame:
    """Documents with a struct column ``into``: words, hit words, items, runs of hit words, cleaned text.

    ``clean_text`` is null where nothing was hit.
    """
    spark = docs.sparkSession
    items = tests.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    fields = [f for f in docs.schema.fields if f.name != into]
    out = docs.drop(into).withColumn(into, F.lit(None).cast(RESULT))
    schema = T.StructType([*fields, T.StructField(into, RESULT)])
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        windows = spark.sparkContext.broadcast(TestWindows([(r.item, r.text) for r in rows], width))
        out = out.mapInArrow(_scan(windows, text, into, block == blocks - 1), schema)
    return out


def decontaminate(docs: DataFrame, tests: DataFrame, *, mode: str = "spans", text: str = "text", **options) -> DataFrame:
    """Documents without test passages.

    ``mode='spans'`` cuts the hit runs out of the texts and drops a document only if no word is left;
    ``mode='documents'`` drops every document with a hit.
    """
    found = find_test_windows(docs, tests, text=text, into="__leak", **options)
    if mode == "documents":
        return found.where("__leak.n_hit = 0").select(*docs.columns)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    kept = found.where("__leak.n_hit = 0 OR __leak.n_hit < __leak.n_words")
    return kept.select(*(F.coalesce("__leak.clean_text", text).alias(text) if c == text else F.col(c) for c in docs.columns))
