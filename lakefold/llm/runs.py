"""Periodic runs of words: seeds on the diagonals of a document's self-comparison, extended to maximal runs.

A run is a stretch of words with smallest period ``q`` of at least ``max(min_length, repeats * q)`` words that no
neighbouring word extends.  On the diagonal of lag ``q`` it is a match of ``length - q`` words in a row, so it holds a
whole aligned k-gram of guaranteed size: lags below 16 are seeded with grams of 8 words, lags of ``[Q, 2Q)`` with grams
of ``Q`` words for ``Q`` = 16, 32, 64 ...  The grams that start at multiples of their size are the index; every other
gram of the same document at a distance of the level is held against it.  A document of ``n`` words so gives at most
``2 n`` pairs a level, whatever it repeats, and ``n log n`` in all.

A seed pair is extended word by word in both directions.  A table with the furthest covered word of each lag
suppresses seeds of a stretch that is already known, and seeds deep inside a run of a shorter period are skipped: two
periods that overlap by their sum have a common divisor as period, so the longer lag would not be the smallest.

The pass is map-only and takes whole texts; memory is a slice of ``SLICE_BYTES`` of text or one longer text.

Defined results: a null or empty text has no words and no runs; repeated rows get equal results; all columns of the
documents pass through, a column named like the result is replaced.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BLANKS, Words, buffers, joined, slices

MIN_LENGTH = 24
REPEATS = 3

#: Gram size and least lag of the first level; the next levels double a gram of 16 words.
_FIRST = (8, 1)

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),  # by start, then period
        T.StructField("top", RUN),  # greatest length / period; ties: smallest start, then period
        T.StructField("collapsed_text", T.StringType()),  # words outside runs and first periods, joined by one space
    ]
)


def _levels(longest: int) -> Iterator[tuple[int, int]]:
    """Gram size and least lag of each level that a document of ``longest`` words can need."""
    gram, lag = _FIRST
    while longest >= max(MIN_LENGTH, REPEATS * lag):
        yield gram, lag
        gram, lag = (16, 16) if lag == 1 else (2 * gram, 2 * lag)


def _seeds(words: Words, hashes: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and later place (words of the row) of equal grams whose distance belongs to the level."""
    at, found = words.windows(hashes, gram)
    known = np.zeros(len(words), np.uint64)
    known[at] = found
    row = np.searchsorted(words.first, at, side="right") - 1
    begin = words.first[row]
    place = at - begin
    anchor = (place - least) // gram * gram
    pairs = []
    for back in (0, gram) if least == 1 else (0,):
        i = anchor - back
        ok = np.flatnonzero((place >= least) & (i >= 0) & (REPEATS * (place - i) <= words.counts[row]))
        ok = ok[known[begin[ok] + i[ok]] == found[ok]]
        pairs.append((row[ok], i[ok], place[ok]))
    rows, i, j = (np.concatenate(part) for part in zip(*pairs))
    order = np.lexsort((i, j - i, rows))
    return rows[order], i[order], j[order]


def _forward(w: np.ndarray, i: int, j: int) -> int:
    """First place from ``j`` on where the diagonal through (i, j) ends."""
    step, n = 32, len(w)
    while j < n:
        m = min(step, n - j)
        differ = w[i : i + m] != w[j : j + m]
        k = int(differ.argmax())
        if differ[k]:
            return j + k
        i, j, step = i + m, j + m, 2 * step
    return n


def _backward(w: np.ndarray, i: int, j: int) -> int:
    """First place of the diagonal through (i, j), looking back from ``i``."""
    step = 32
    while i > 0:
        m = min(step, i)
        differ = (w[i - m : i] != w[j - m : j])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, j, step = i - m, j - m, 2 * step
    return 0


def _smallest(w: np.ndarray, start: int, period: int) -> bool:
    """Whether no proper divisor of ``period`` is a period of a stretch of at least three periods."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if np.array_equal(w[start : start + period], w[start + part : start + part + period]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


class _Document:
    """Runs found so far and the furthest covered anchor of each lag."""

    def __init__(self, w: np.ndarray):
        self.w, self.covered, self.runs = w, {}, []

    def add(self, anchors: np.ndarray, places: np.ndarray, gram: int) -> None:
        if self.runs:  # all of shorter periods than the level's lags
            begins = np.array([s for s, _, q in self.runs if q <= gram])
            if len(begins):
                order = np.argsort(begins, kind="stable")
                ends = np.maximum.accumulate(np.array([s + n for s, n, q in self.runs if q <= gram])[order])
                inside = np.searchsorted(begins[order], anchors, side="right") - 1
                open_ = (inside < 0) | (ends[inside] < places + gram)
                anchors, places = anchors[open_], places[open_]
        for i, j in zip(anchors.tolist(), places.tolist()):
            q = j - i
            if i < self.covered.get(q, 0):
                continue
            start, end = _backward(self.w, i, j), _forward(self.w, i, j)
            self.covered[q] = end - q
            if end - start >= max(MIN_LENGTH, REPEATS * q) and _smallest(self.w, start, q):
                self.runs.append((start, end - start, q))


def slice_runs(words: Words) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of the rows that have any, by start, then period."""
    hashes = words.hashes()
    documents: dict[int, _Document] = {}
    for gram, least in _levels(int(words.counts.max(initial=0))):
        rows, i, j = _seeds(words, hashes, gram, least)
        edges = np.flatnonzero(np.diff(rows, prepend=-1, append=-1)) if len(rows) else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            row = int(rows[lo])
            if row not in documents:
                documents[row] = _Document(hashes[words.first[row] : words.first[row + 1]])
            documents[row].add(i[lo:hi], j[lo:hi], gram)
    return {row: sorted(d.runs, key=lambda r: (r[0], r[2])) for row, d in documents.items() if d.runs}


def _top(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for run in runs[1:]:  # already by start, then period
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _scan(text: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text))
            kind = batch.schema.field(into).type
            for row, end in slices(offsets):
                words = Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], BLANKS, lower=False)
                runs = slice_runs(words)
                kept = np.ones(len(words), bool)
                for r, found in runs.items():
                    for start, length, period in found:
                        kept[words.first[r] + start + period : words.first[r] + start + length] = False
                texts = joined(words, kept)
                keys = ("start", "length", "period")
                results = [
                    {
                        "n_words": n,
                        "runs": [dict(zip(keys, one)) for one in runs.get(r, ())],
                        "top": dict(zip(keys, _top(runs[r]))) if r in runs else None,
                        "collapsed_text": texts[r],
                    }
                    for r, n in enumerate(words.counts.tolist())
                ]
                part = batch.slice(row, end - row)
                columns = [part.column(c) if c != into else pa.array(results, kind) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return run


def find_runs(docs: DataFrame, *, text: str = "text", into: str = "periodic") -> DataFrame:
    """Documents with a struct column ``into``: words, all runs, the run of the greatest exponent, collapsed text."""
    fields = [f for f in docs.schema.fields if f.name != into]
    prepared = docs.drop(into).withColumn(into, F.lit(None).cast(RESULT))
    return prepared.mapInArrow(_scan(text, into), T.StructType([*fields, T.StructField(into, RESULT)]))


def collapse_runs(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same documents; texts with runs keep only the first period of each, other texts stay as they are."""
    found = find_runs(docs, text=text, into="__periodic")
    short = F.when(F.size("__periodic.runs") > 0, F.col("__periodic.collapsed_text")).otherwise(F.col(text))
    return found.select(*(short.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))
