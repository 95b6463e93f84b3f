"""Repeated phrases: recurring passages are confirmed, compiled into automata, and located in all documents.

A window is ``width`` consecutive words of one document.  A word goes if a window covers it whose words also start in a
document with a smaller key.  Windows are judged on the input, not on what is left of it.

*Candidates.*  Every window names its anchor: the gram of ``GRAM`` words in it with the least hash, so equal windows
name equal anchors.  Anchors that several documents have are marked in a bitmap of fixed size (``FILTER_BITS``), summed
up on the map side; a wrong mark costs work and changes nothing.  A second bitmap marks anchors of more than ``hot``
places.

*Pieces.*  The neighbouring windows of a marked anchor travel as one piece of text to the shard of the anchor.  Windows
of hot anchors travel alone to the shard of their own hash, so a common line does not draw its whole surroundings into
one shard.

*Automata.*  Equal pieces are first merged to one row with their least and greatest key.  A shard's distinct pieces
confirm its recurring windows, which are compiled into an Aho-Corasick automaton that locates them in every piece; then
the shard's pieces of all documents stream by, as hashes (64 bits beside the shard's own 64).  A shard holds fewer than
``hot`` distinct pieces (or those of one window hash), and the stream of a shard with more than a thousandth of all
pieces is split over several copies of its automaton.

*Result.*  The located stretches return to their document by key and text hash.

Defined results: a null or empty text has no words; documents with a null key lose nothing and take nothing from
others; rows with one key do not take from each other, and repeated rows get equal results.  Keys of any ordered type
work.  All columns pass through, a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored, stored_at
from .words import BLANKS, Words, buffers, joined, joined_bytes, slices, span_hashes

WIDTH = 13
GRAM = 4
HOT = 4096

#: The bitmaps have 2 ** FILTER_BITS bits, 16 MB each, at every size of the corpus.
FILTER_BITS = 27
_BLOCK_BITS = 15

_SLICE = 1 << 20
_OUT_ROWS = 8192

SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(SPAN)),  # runs of removed words
        T.StructField("kept_text", T.StringType()),  # kept words joined by one space
    ]
)


class _Anchored:
    """The windows of a slice, grouped by the anchor that they name."""

    def __init__(self, words: Words, width: int):
        hashes = words.hashes()
        at, grams = words.windows(hashes, GRAM)
        dense = np.full(len(words) + width, ~np.uint64(0))
        dense[at] = grams
        self.starts, self.window_hashes = words.windows(hashes, width)
        views = np.lib.stride_tricks.sliding_window_view(dense, width - GRAM + 1)[self.starts]
        place = self.starts + views.argmin(axis=1) if len(self.starts) else self.starts
        self.edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1)) if len(place) else np.zeros(1, np.int64)
        self.anchors = dense[place[self.edges[:-1]]] if len(place) else np.zeros(0, np.uint64)
        self.rows = np.searchsorted(words.first, self.starts[self.edges[:-1]], side="right") - 1 if len(place) else self.starts


def _marked(bits: np.ndarray, anchors: np.ndarray, filter_bits: int) -> np.ndarray:
    place = (anchors >> np.uint64(64 - filter_bits)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _word_slices(batch: pa.RecordBatch, text: int):
    data, offsets = buffers(batch.column(text))
    for row, end in slices(offsets, _SLICE):
        yield row, end, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], BLANKS, lower=False)


def _list_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, words in _word_slices(batch, 1):
                found = _Anchored(words, width)
                keys = batch.column(0).take(pa.array(row + found.rows))
                yield pa.RecordBatch.from_arrays([pa.array(found.anchors.view(np.int64)), keys], names=["anchor", "key"])

    return run


def _bitmap(anchors: DataFrame, filter_bits: int) -> np.ndarray:
    """A bitmap over the anchors' leading bits, merged by tasks into blocks of four kilobytes."""
    place = F.shiftrightunsigned("anchor", 64 - filter_bits)
    blocks = anchors.groupBy(F.shiftright(place, _BLOCK_BITS).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))).alias("bits")
    )
    out = np.zeros(1 << (filter_bits - 3), np.uint8)
    for row in blocks.toLocalIterator():  # at most 2 ** (filter_bits - 15) rows
        out[row.block << (_BLOCK_BITS - 3) : (row.block + 1) << (_BLOCK_BITS - 3)] = np.frombuffer(row.bits, np.uint8)
    return out


def _cut_pieces(marks, width: int, filter_bits: int, columns: list[str]):
    """Pieces around marked anchors: their shard and hash, and of ``columns`` the text, the place, the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = marks.value
        for batch in batches:
            for row, _, words in _word_slices(batch, 1):
                found = _Anchored(words, width)
                use = np.flatnonzero(_marked(shared, found.anchors, filter_bits))
                if not len(use):
                    continue
                alone = _marked(hot, found.anchors[use], filter_bits)
                group = use[~alone]
                single = np.concatenate([np.arange(found.edges[s], found.edges[s + 1]) for s in use[alone]] or [np.zeros(0, np.int64)])
                owner = np.repeat(use[alone], found.edges[use[alone] + 1] - found.edges[use[alone]])
                begin = np.concatenate([found.starts[found.edges[group]], found.starts[single]])
                last = np.concatenate([found.starts[found.edges[group + 1] - 1], found.starts[single]]) + width - 1
                rows = np.concatenate([found.rows[group], found.rows[owner]])
                raw, _ = joined_bytes(words, np.ones(len(words), bool))
                sizes = words.ends - words.starts + 1
                places = np.cumsum(sizes) - sizes  # of each word in ``raw``
                lo, hi = places[begin], places[last] + sizes[last] - 1
                taken = pa.array(row + rows)
                make = {
                    "shard": lambda: pa.array(np.concatenate([found.anchors[group], found.window_hashes[single]]).view(np.int64)),
                    "piece": lambda: pa.array(span_hashes(np.frombuffer(raw, np.uint8), lo, hi).view(np.int64)),
                    "text": lambda: pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())], pa.string()),
                    "start": lambda: pa.array(begin - words.first[rows]),
                    "key": lambda: batch.column(0).take(taken),
                    "row": lambda: batch.column(2).take(taken),
                }
                whole = pa.RecordBatch.from_arrays([make[c]() for c in columns], names=columns)
                for at in range(0, len(whole), _OUT_ROWS):
                    yield whole.slice(at, _OUT_ROWS)

    return run


class _Shard:
    """Distinct pieces of one shard, its automaton, and the recurring windows located in each piece."""

    def __init__(self, width: int):
        self.width, self.texts, self.least, self.greatest = width, {}, {}, {}

    def add(self, piece: int, text: str, first, last) -> None:
        self.texts[piece] = text
        words = text.split(" ")
        for i in range(len(words) - self.width + 1):
            window = " ".join(words[i : i + self.width])
            if window not in self.least:
                self.least[window], self.greatest[window] = first, last
            else:
                self.least[window] = min(self.least[window], first)
                self.greatest[window] = max(self.greatest[window], last)

    def located(self) -> dict[int, list[tuple[int, object]]]:
        """First word and least key of each recurring window, by piece."""
        automaton = ahocorasick.Automaton()
        for window, first in self.least.items():
            if first < self.greatest[window]:
                automaton.add_word(f" {window} ", (first, len(window)))
        if not len(automaton):
            return {}
        automaton.make_automaton()
        out = {}
        for piece, text in self.texts.items():
            line = f" {text} "
            hits = [(line.count(" ", 0, end - size - 1), first) for end, (first, size) in automaton.iter(line)]
            if hits:
                out[piece] = hits
        return out


def _stream(width: int):
    """Sorted rows of shards, distinct pieces before their places, to removed stretches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, located = None, None, None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            names = ("shard", "salt", "kind", "piece", "text", "key", "last", "row", "start")
            for number, salt, kind, piece, text, key, last, row, start in zip(*(batch.column(c).to_pylist() for c in names)):
                if (number, salt) != current:
                    current, shard, located = (number, salt), _Shard(width), None
                if kind == 0:
                    shard.add(piece, text, key, last)
                    continue
                if located is None:
                    located, shard = shard.located(), None
                gone = [place for place, first in located.get(piece, ()) if first < key]
                if gone:  # windows of a piece overlap, so they are one stretch
                    for column, value in zip(out, (key, row, start + min(gone), start + max(gone) + width)):
                        column.append(value)
            kinds = [batch.schema.field("key").type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["key", "row", "begin", "end"])

    return run


def _mark(text: str, spans: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(into).type
            for row, end, words in _word_slices(batch, batch.schema.get_field_index(text)):
                part = batch.slice(row, end - row)
                edge = np.zeros(len(words) + 1, np.int64)
                for r, found in enumerate(part.column(spans).to_pylist()):
                    for span in found or ():
                        edge[words.first[r] + span["begin"]] += 1
                        edge[words.first[r] + span["end"]] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                texts = joined(words, ~gone)
                results = []
                for r in range(end - row):
                    mine = gone[words.first[r] : words.first[r + 1]]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))).tolist()
                    removed = [{"begin": a, "end": b} for a, b in zip(turns[::2], turns[1::2])]
                    results.append({"n_words": len(mine), "n_removed": int(mine.sum()), "removed": removed, "kept_text": texts[r]})
                names = [n for n in part.schema.names if n != spans]
                columns = [part.column(n) if n != into else pa.array(results, kind) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    hot: int = HOT,
    filter_bits: int = FILTER_BITS,
    into: str = "repeats",
) -> DataFrame:
    """Documents with a struct column ``into``: words, removed words and their stretches, the text that is left."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("row")).where("key IS NOT NULL AND text IS NOT NULL")

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields])

    long, string = T.LongType(), T.StringType()
    anchors = texts.select("key", "text").mapInArrow(_list_anchors(width), schema(("anchor", long), ("key", kind)))
    counted = anchors.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("greatest"), F.count("*").alias("places"))
    shared, folder = stored_at(counted.where("least < greatest").select("anchor", (F.col("places") >= hot).alias("hot")), "anchors")
    marks = spark.sparkContext.broadcast((_bitmap(shared, filter_bits), _bitmap(shared.where("hot"), filter_bits)))
    discard(spark, folder)

    types = {"shard": long, "piece": long, "text": string, "start": long, "key": kind, "row": long}

    def pieces(*columns: str) -> DataFrame:
        return texts.mapInArrow(_cut_pieces(marks, width, filter_bits, list(columns)), schema(*((c, types[c]) for c in columns)))

    distinct = pieces("shard", "piece", "text", "key").groupBy("shard", "piece", "text")
    merged = distinct.agg(F.min("key").alias("key"), F.max("key").alias("last"), F.count("*").alias("places"))
    distinct = stored(merged.sortWithinPartitions("shard", "text"), "pieces", "zstd")  # neighbours are alike and pack well

    sizes = distinct.groupBy("shard").agg(F.sum("places").alias("places"))
    share = max(1000, (distinct.agg(F.sum("places")).first()[0] or 0) // 1000)
    large = F.broadcast(sizes.where(F.col("places") > share).select("shard", F.floor(F.col("places") / share).cast("int").alias("more")))  # fewer than 1000 rows
    extra, one = F.coalesce("more", F.lit(0)), F.lit(None)
    patterns = distinct.join(large, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0), extra)).alias("salt"), F.lit(0).alias("kind"), "piece", "text", "key", "last", one.cast("long").alias("row"), one.cast("long").alias("start")
    )
    stream = pieces("shard", "piece", "key", "row", "start").join(large, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("key", "row"), extra + 1).cast("int").alias("salt"), F.lit(1).alias("kind"), "piece", one.cast("string").alias("text"), "key", one.cast(kind).alias("last"), "row", "start"
    )
    rows = patterns.unionByName(stream).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    found = rows.mapInArrow(_stream(width), schema(("key", kind), ("row", long), ("begin", long), ("end", long)))
    spans = found.groupBy("key", "row").agg(F.collect_list(F.struct("begin", "end")).alias("__spans"))

    fields = [f for f in docs.schema.fields if f.name != into]
    keyed = docs.drop(into).withColumn("__row", F.xxhash64(text)).withColumn(into, F.lit(None).cast(RESULT))
    matched = keyed.join(spans.withColumnRenamed("key", "__key").withColumnRenamed("row", "__row_of"), (F.col(key) == F.col("__key")) & (F.col("__row") == F.col("__row_of")), "left")
    ready = matched.select(*(F.col(f"`{f.name}`") for f in fields), into, "__spans")
    return ready.mapInArrow(_mark(text, "__spans", into), T.StructType([*fields, T.StructField(into, RESULT)]))


def drop_repeats(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """Documents without repeated passages; a text that loses words keeps the others joined by one space, one that loses all goes."""
    found = remove_repeats(docs, text=text, into="__repeats", **options)
    kept = found.where("__repeats.n_removed = 0 OR __repeats.n_removed < __repeats.n_words")
    short = F.when(F.col("__repeats.n_removed") > 0, F.col("__repeats.kept_text")).otherwise(F.col(text))
    return kept.select(*(short.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))
